"""Window features of reduced series.

All window expressions of a call share one partitioning and order, so Catalyst
plans a single shuffle and sort for them. Standard deviations are sample ones
except the z-score's, which is the population one.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import attach, by_time, change_rate, complete_rows, per_series, ratio, trailing
from .profile import numeric_columns, top_k_features
from .resample import season_columns

# The default lags and rolling windows.
LAGS = (1, 2, 3, 6, 12)
WINDOWS = (3, 6, 12)


def lag_columns(keys: Sequence[str], ts: str, y: str, lags: Sequence[int] = LAGS) -> dict[str, Column]:
    w = by_time(keys, ts)
    return {f"{y}_lag_{k}": F.lag(y, k).over(w) for k in lags}


def rolling_columns(
    keys: Sequence[str], ts: str, y: str, windows: Sequence[int] = WINDOWS, prefix: str | None = None, back: int = 0
) -> dict[str, Column]:
    w = by_time(keys, ts)
    stem = f"{y}_rolling" if prefix is None else prefix
    stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    return {
        f"{stem}_{name}_{n}": trailing(fn, F.col(y), w, n, back) for n in windows for name, fn in stats.items()
    }


def lag_features(
    df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y", lags: Sequence[int] = LAGS
) -> DataFrame:
    """Values 1, 2, 3, 6 and 12 rows earlier."""
    return df.withColumns(lag_columns(keys, ts, y, lags))


def rolling_features(
    df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y", windows: Sequence[int] = WINDOWS
) -> DataFrame:
    """Mean, std, min, max of the last n rows including this one; null until n rows exist."""
    return df.withColumns(rolling_columns(keys, ts, y, windows))


def trend_columns(keys: Sequence[str], ts: str, y: str) -> dict[str, Column]:
    w = by_time(keys, ts)
    now = F.col(y)
    before, before2 = F.lag(y, 1).over(w), F.lag(y, 2).over(w)
    growth = change_rate(now, before)
    short, long = trailing(F.avg, now, w, 3), trailing(F.avg, now, w, 12)
    return {
        "linear_trend": F.row_number().over(w) - 1,
        "growth_rate": growth,
        "ma_short": short,
        "ma_long": long,
        "trend_direction": F.when(short > long, 1).otherwise(0),
        "acceleration": growth - change_rate(before, before2),
    }


def trend_features(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y") -> DataFrame:
    """Row index, growth, short and long moving average, direction flag (0 while unknown), acceleration."""
    return df.withColumns(trend_columns(keys, ts, y))


def statistical_columns(keys: Sequence[str], ts: str, y: str) -> dict[str, Column]:
    w, whole = by_time(keys, ts), per_series(keys)
    now = F.col(y)
    mean = F.avg(y).over(whole)
    spread = ratio(trailing(F.stddev_samp, now, w, 12), trailing(F.avg, now, w, 12))
    ties = F.count(y).over(Window.partitionBy(*keys, y))
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(y))
    return {
        f"{y}_zscore": ratio(now - mean, F.stddev_pop(y).over(whole)),
        f"{y}_percentile": (rank + (ties - 1) / 2) / F.count(y).over(whole),
        "distance_from_mean": F.abs(now - mean),
        "volatility": spread,
        "cv": spread,
    }


def statistical_features(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y") -> DataFrame:
    """z-score, percentile rank (average ties), distance from the mean, 12-row variation (twice, by name)."""
    return df.withColumns(statistical_columns(keys, ts, y))


def all_features(
    df: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "ts",
    y: str = "y",
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    seasonal: bool = True,
    trend: bool = True,
    statistical: bool = True,
) -> DataFrame:
    """Every feature family in one projection; rows with a null feature are dropped."""
    out: dict[str, Column] = {}
    if lags:
        out |= lag_columns(keys, ts, y, lags)
    if windows:
        out |= rolling_columns(keys, ts, y, windows)
    if seasonal:
        out |= season_columns(ts)
    if trend:
        out |= trend_columns(keys, ts, y)
    if statistical:
        out |= statistical_columns(keys, ts, y)
    return complete_rows(df.withColumns(out))


def model_feature_columns(
    keys: Sequence[str],
    ts: str,
    y: str,
    n_lags: int = 12,
    windows: Sequence[int] = WINDOWS,
    lagged: bool = False,
    before: Column | None = None,
) -> dict[str, Column]:
    """The 43 regression features; ``lagged`` ends every frame one row earlier, so none sees its own target.

    ``before`` counts the rows of the series that come before those given.
    """
    w = by_time(keys, ts)
    back = 1 if lagged else 0
    value = F.col(y)
    now = F.lag(y, back).over(w) if back else value
    earlier = F.lag(y, back + 1).over(w)
    season = season_columns(ts)
    index = F.row_number().over(w) - 1 if before is None else F.row_number().over(w) - 1 + before
    growth = change_rate(now, earlier)
    short, long = trailing(F.avg, value, w, 3, back), trailing(F.avg, value, w, 12, back)
    calendar = ("year", "month", "quarter", "day_of_year", "month_sin", "month_cos", "quarter_sin", "quarter_cos")
    out = lag_columns(keys, ts, y, range(1, n_lags + 1))
    out |= rolling_columns(keys, ts, y, windows, prefix="rolling", back=back)
    out |= {name: season[name] for name in calendar}
    out |= {
        "linear_trend": index,
        "quadratic_trend": index * index,
        "growth_rate": growth,
        "momentum": now - earlier,
        "ma_ratio": ratio(short, long),
        "ma_diff": short - long,
        "volatility": ratio(trailing(F.stddev_samp, value, w, 12, back), long),
        "is_q4": (season["quarter"] == 4).cast("int"),
        "is_holiday_season": season["is_holiday_season"],
        "trend_month": index * season["month"],
        "growth_season": growth * season["month_sin"],
    }
    return out


def model_features(
    df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y", lagged: bool = False, **options
) -> DataFrame:
    """Regression feature set, rows with nulls dropped."""
    return complete_rows(df.withColumns(model_feature_columns(keys, ts, y, lagged=lagged, **options)))


def lookback_sequences(
    df: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "ts",
    y: str = "y",
    lookback: int = 12,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """(keys, ts, window, target): the previous ``lookback`` rows of the columns, oldest first, and this value.

    With one column the window is an array of numbers, with several an array of
    structs. The frame bounds the array, so its size never grows with the data.
    """
    names = list(columns or [y])
    item = F.col(names[0]) if len(names) == 1 else F.struct(*names)
    frame = by_time(keys, ts).rowsBetween(-lookback, -1)
    return (
        df.select(*keys, ts, F.collect_list(item).over(frame).alias("window"), F.col(y).alias("target"))
        .where(F.size("window") == lookback)
    )


# ---- scaling and selection ---------------------------------------------------------

def fit_scaler(
    df: DataFrame, columns: Sequence[str], method: str = "standard", keys: Sequence[str] = ()
) -> DataFrame:
    """One row per key with a (center, width) pair per column; save it to reuse the same scaling later."""
    def pair(c: str) -> Column:
        x = F.col(c).cast("double")
        if method == "standard":
            return F.struct(F.avg(x).alias("center"), F.stddev_pop(x).alias("width"))
        if method == "minmax":
            return F.struct(F.min(x).alias("center"), (F.max(x) - F.min(x)).alias("width"))
        raise ValueError(f"unsupported scaling method {method!r}; standard or minmax")

    return df.groupBy(*keys).agg(*[pair(c).alias(c) for c in columns])


def apply_scaler(df: DataFrame, scaler: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Scale the columns the scaler knows; a constant column becomes 0."""
    names = [c for c in scaler.columns if c not in keys]

    def scaled(c: str) -> Column:
        value, center, width = F.col(c), F.col(f"_s.{c}.center"), F.col(f"_s.{c}.width")
        moved = value.cast("double") - center
        return F.when(width == 0, F.when(value.isNotNull(), 0.0)).otherwise(ratio(moved, width))

    return attach(df, scaler, keys, "_s").withColumns({c: scaled(c) for c in names}).drop("_s")


def scale_features(
    df: DataFrame,
    method: str = "standard",
    target: str = "y",
    keys: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    scaler: DataFrame | None = None,
) -> DataFrame:
    """Standard (population std) or min-max scaling of the numeric columns except the target."""
    names = list(columns or numeric_columns(df, (*keys, target)))
    if not names:
        return df
    return apply_scaler(df, scaler if scaler is not None else fit_scaler(df, names, method, keys), keys)


def interaction_features(df: DataFrame, columns: Sequence[str], degree: int = 2) -> DataFrame:
    """Products of 2..degree different columns, named ``a b``; no bias, no powers."""
    out: dict[str, Column] = {}
    for size in range(2, degree + 1):
        for group in combinations(columns, size):
            product = F.col(group[0]).cast("double")
            for c in group[1:]:
                product = product * F.col(c)
            out[" ".join(group)] = product
    return df.withColumns(out) if out else df


def select_k_best(
    df: DataFrame, target: str = "y", k: int = 15, keys: Sequence[str] = (), features: Sequence[str] | None = None
) -> DataFrame:
    """The k features with the largest F statistic of a one-feature regression, with the statistic.

    F = r2 / (1 - r2) * (n - 2) grows with |r|, so ranking by |r| gives the same
    choice without p-values that underflow on large data.
    """
    ranked = top_k_features(df, target, k, keys, features)
    sizes = df.groupBy(*keys).agg(F.count(target).alias("n"))
    r2 = F.col("importance") * F.col("importance")
    return (
        attach(ranked, sizes, keys, "_n")
        .withColumn("f_score", ratio(r2 * (F.col("_n.n") - 2), 1 - r2))
        .drop("_n")
    )


