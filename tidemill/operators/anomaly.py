"""Outlier detection, consensus, summary and treatment.

``scale="series"`` (default) is for frames reduced to periods: statistics are
window aggregates over the series, one shuffle, no join. ``scale="rows"`` is
for raw rows of any number per key: statistics are partial + final aggregates
and exact distributed quantiles, put beside the rows without collecting a key.
Flags are never null: a point that cannot be scored is not an outlier.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import attach, by_time, clock_seconds, full_frame, per_series, ratio
from ..functions.quantiles import exact_quantiles, series_quantile
from ..session import settle
from .isolation import isolation_scores

# Contamination and fence threshold of each sensitivity.
SENSITIVITY = {"high": (0.15, 1.5), "medium": (0.10, 2.0), "low": (0.05, 2.5)}
# Fixed value: scales the median deviation to a normal standard deviation.
MAD_FACTOR = 0.6745


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _with_quantiles(
    df: DataFrame, keys: Sequence[str], y: str, probs: Sequence[float], scale: str, accuracy: int, rule: str = "linear"
) -> tuple[DataFrame, list[Column]]:
    """The frame with struct ``_q`` of the quantiles, and their columns."""
    names = [f"p{i}" for i in range(len(probs))]
    if scale == "series" and rule == "linear":
        out = df.withColumn("_q", F.struct(*[series_quantile(y, p, keys).alias(n) for p, n in zip(probs, names)]))
    elif scale in ("rows", "series"):
        out = attach(df, exact_quantiles(df, keys, y, probs, rule, accuracy, names), keys, "_q", raw=True)
    else:
        raise ValueError(f"unknown scale {scale!r}; series or rows")
    return out, [F.col(f"_q.{n}") for n in names]


def iqr_outliers(
    df: DataFrame, keys: Sequence[str] = (), y: str = "y", threshold: float = 1.5, scale: str = "series", accuracy: int = 10_000
) -> DataFrame:
    """Outside q25 - t*IQR .. q75 + t*IQR; score = distance beyond the fence in IQRs."""
    held, (q1, q3) = _with_quantiles(df, keys, y, (0.25, 0.75), scale, accuracy)
    iqr = q3 - q1
    low, high, v = q1 - threshold * iqr, q3 + threshold * iqr, F.col(y)
    score = F.when(v < low, ratio(low - v, iqr)).when(v > high, ratio(v - high, iqr)).otherwise(0.0)
    return held.withColumns(
        {"is_outlier_iqr": _flag((v < low) | (v > high)), "outlier_score_iqr": score}
    ).drop("_q")


def zscore_outliers(
    df: DataFrame, keys: Sequence[str] = (), y: str = "y", threshold: float = 1.5, scale: str = "series"
) -> DataFrame:
    """|y - mean| / population std above the threshold."""
    if scale == "rows":
        facts = df.groupBy(*keys).agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"))
        held = attach(df, facts, keys, "_f", raw=True)
    else:
        whole = per_series(keys)
        held = df.withColumn(
            "_f", F.struct(F.avg(y).over(whole).alias("mean"), F.stddev_pop(y).over(whole).alias("std"))
        )
    z = F.abs(ratio(F.col(y) - F.col("_f.mean"), F.col("_f.std")))
    return held.withColumns(
        {"is_outlier_zscore": _flag(z > threshold), "outlier_score_zscore": z}
    ).drop("_f")


def modified_zscore_outliers(
    df: DataFrame, keys: Sequence[str] = (), y: str = "y", threshold: float = 3.5, scale: str = "series", accuracy: int = 10_000
) -> DataFrame:
    """0.6745 |y - median| / MAD above the threshold; a MAD of 0 gives a null score and no flag."""
    centred, (median,) = _with_quantiles(df, keys, y, (0.5,), scale, accuracy)
    moved = centred.withColumn("_dev", F.abs(F.col(y) - median)).drop("_q")
    held, (mad,) = _with_quantiles(moved, keys, "_dev", (0.5,), scale, accuracy)
    score = ratio(MAD_FACTOR * F.col("_dev"), mad)
    return held.withColumns(
        {"is_outlier_modified_zscore": _flag(score > threshold), "outlier_score_modified_zscore": score}
    ).drop("_q", "_dev")


def seasonal_outliers(
    df: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "ts",
    y: str = "y",
    threshold: float = 2.5,
    season: Column | None = None,
) -> DataFrame:
    """z against the same season's mean and sample std (calendar month unless given).

    Seasons with one point use the whole series; a zero std scores 0.
    """
    s = season if season is not None else F.month(ts)
    held = df.withColumn("_season", s)
    mine, whole = Window.partitionBy(*keys, "_season"), per_series(keys)
    enough = F.count("*").over(mine) > 1
    mean = F.when(enough, F.avg(y).over(mine)).otherwise(F.avg(y).over(whole))
    std = F.when(enough, F.stddev_samp(y).over(mine)).otherwise(F.stddev_samp(y).over(whole))
    z = F.when(std > 0, F.abs((F.col(y) - mean) / std)).otherwise(0.0)
    return (
        held.withColumn("seasonal_zscore", z)
        .withColumn("is_outlier_seasonal", _flag(F.col("seasonal_zscore") > threshold))
        .drop("_season")
    )


def rolling_outliers(
    df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y", window: int = 5, threshold: float = 2.0
) -> DataFrame:
    """z against a centred window's mean and sample std; incomplete windows score 0.

    A window of n containing the point bounds |z| by (n-1)/sqrt(n), so with the
    default 5 rows the default threshold of 2 is out of reach; use 7 or more
    rows for a detector that can fire.
    """
    w = by_time(keys, ts)
    first, last = -(window // 2), window - 1 - window // 2
    mean = full_frame(F.avg, F.col(y), w, first, last)
    std = full_frame(F.stddev_samp, F.col(y), w, first, last)
    z = F.coalesce(F.abs(ratio(F.col(y) - mean, std)), F.lit(0.0))
    return df.withColumn("rolling_zscore", z).withColumn(
        "is_outlier_rolling", F.col("rolling_zscore") > threshold
    )


def isolation_outliers(
    df: DataFrame,
    keys: Sequence[str] = (),
    row_id: Sequence[str] = ("ts",),
    features: Sequence[str] = ("y",),
    contamination: float = 0.1,
    scale: str = "series",
    seed: int = 42,
    trees: int = 100,
    accuracy: int = 10_000,
) -> DataFrame:
    """Isolation forest score (0..1, higher is odder) and the top ``contamination`` share as outliers."""
    scored = isolation_scores(df, keys, row_id, features, scale, seed, trees)
    if scale == "rows":  # the threshold reads the scores more than once
        scored = settle(scored)
    held, (limit,) = _with_quantiles(scored, keys, "outlier_score_isolation", (1 - contamination,), scale, accuracy)
    return held.withColumn("is_outlier_isolation", _flag(F.col("outlier_score_isolation") > limit)).drop("_q")


def vote(df: DataFrame, min_votes: int = 2) -> DataFrame:
    """Add votes, the consensus flag and the mean score over the method columns present."""
    flags = [c for c in df.columns if c.startswith("is_outlier_") and c != "is_outlier_consensus"]
    scores = [c for c in df.columns if c.startswith("outlier_score_") and c != "outlier_score_combined"]
    votes = sum((F.col(c).cast("int") for c in flags), F.lit(0))
    out = df.withColumn("outlier_votes", votes).withColumn("is_outlier_consensus", F.col("outlier_votes") >= min_votes)
    if scores:
        present = sum((F.col(c).isNotNull().cast("int") for c in scores), F.lit(0))
        total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in scores), F.lit(0.0))
        out = out.withColumn("outlier_score_combined", ratio(total, present))
    return out


def consensus_outliers(
    df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y", isolation: bool = True, contamination: float = 0.1
) -> DataFrame:
    """IQR, z (2.5), isolation forest, seasonal and rolling votes; two votes make an outlier."""
    out = iqr_outliers(df, keys, y)
    out = zscore_outliers(out, keys, y, 2.5)
    if isolation:
        out = isolation_outliers(out, keys, (ts,), (y,), contamination)
    out = seasonal_outliers(out, keys, ts, y)
    return vote(rolling_outliers(out, keys, ts, y))


# ---- reports ---------------------------------------------------------------------

def outlier_summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, method, n_outliers, pct, total): one row per flag column present."""
    flags = [c for c in df.columns if c.startswith("is_outlier_")]
    wide = df.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(F.col(c)).alias(c) for c in flags])
    rows = F.array(
        *[F.struct(F.lit(c.removeprefix("is_outlier_")).alias("method"), F.col(c).alias("n_outliers")) for c in flags]
    )
    return wide.select(*keys, "total", F.explode(rows).alias("_r")).select(
        *keys,
        "_r.method",
        "_r.n_outliers",
        F.round(ratio(F.col("_r.n_outliers") * 100.0, F.col("total")), 2).alias("pct"),
        "total",
    )


def vote_histogram(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, "outlier_votes").agg(F.count("*").alias("n"))


def consensus_dates(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """(keys, ts) of the consensus outliers; left as rows, so no series' dates are gathered in one cell."""
    return df.where("is_outlier_consensus").select(*keys, ts)


def anomaly_patterns(
    df: DataFrame, flag: str, keys: Sequence[str] = (), ts: str = "ts", y: str = "y"
) -> DataFrame:
    """Counts and mean/min/max/std of the anomalous values, overall, by month and by year, in one pass."""
    hits = df.where(F.col(flag)).select(
        *keys, F.month(ts).alias("month"), F.year(ts).alias("year"), F.col(y).alias("_y")
    )
    sets = [[*keys], [*keys, "month"], [*keys, "year"]]
    grouped = hits.groupingSets([[F.col(c) for c in s] for s in sets], *keys, "month", "year").agg(
        F.count("*").alias("n"),
        F.avg("_y").alias("mean_value"),
        F.min("_y").alias("min_value"),
        F.max("_y").alias("max_value"),
        F.stddev_samp("_y").alias("std_value"),
    )
    level = F.when(F.col("month").isNotNull(), "month").when(F.col("year").isNotNull(), "year").otherwise("all")
    return grouped.withColumn("level", level)


def anomaly_points(
    df: DataFrame,
    method: str = "comprehensive",
    sensitivity: str = "medium",
    keys: Sequence[str] = (),
    ts: str = "ts",
    y: str = "y",
) -> DataFrame:
    """(keys, ts, y, is_anomaly, anomaly_score) by one named method and sensitivity preset."""
    if sensitivity not in SENSITIVITY:
        raise ValueError(f"unknown sensitivity {sensitivity!r}; one of {sorted(SENSITIVITY)}")
    contamination, threshold = SENSITIVITY[sensitivity]
    if method == "comprehensive":
        out, flag, score = consensus_outliers(df, keys, ts, y), "is_outlier_consensus", "outlier_score_combined"
    elif method == "isolation_forest":
        out = isolation_outliers(df, keys, (ts,), (y,), contamination)
        flag, score = "is_outlier_isolation", "outlier_score_isolation"
    elif method == "statistical":
        out, flag, score = iqr_outliers(df, keys, y, threshold), "is_outlier_iqr", "outlier_score_iqr"
    elif method == "seasonal":
        out, flag, score = seasonal_outliers(df, keys, ts, y), "is_outlier_seasonal", "seasonal_zscore"
    else:
        raise ValueError(f"unsupported detection method {method!r}")
    return out.select(*keys, ts, y, F.col(flag).alias("is_anomaly"), F.col(score).alias("anomaly_score"))


def detect(
    df: DataFrame, methods: Sequence[str] = ("comprehensive",), keys: Sequence[str] = (), ts: str = "ts", y: str = "y"
) -> DataFrame:
    """Apply the named detectors in turn: iqr, zscore, isolation_forest, seasonal, or comprehensive for all."""
    if "comprehensive" in methods:
        return consensus_outliers(df, keys, ts, y)
    steps = {
        "iqr": lambda d: iqr_outliers(d, keys, y),
        "zscore": lambda d: zscore_outliers(d, keys, y),
        "modified_zscore": lambda d: modified_zscore_outliers(d, keys, y),
        "isolation_forest": lambda d: isolation_outliers(d, keys, (ts,), (y,)),
        "seasonal": lambda d: seasonal_outliers(d, keys, ts, y),
        "rolling": lambda d: rolling_outliers(d, keys, ts, y),
    }
    unknown = [m for m in methods if m not in steps]
    if unknown:
        raise ValueError(f"unsupported detection methods {unknown}; of {sorted(steps)}")
    for m in methods:
        df = steps[m](df)
    return df


def iqr_floor_outliers(
    df: DataFrame, columns: Sequence[str], row_id: Sequence[str], keys: Sequence[str] = (), threshold: float = 1.5, accuracy: int = 10_000
) -> DataFrame:
    """Long list (keys, row id, column, value) of the values outside fences from floor-index quartiles.

    Works on raw rows: the quartiles are exact distributed selections.
    """
    names = list(columns)
    held = df
    for i, c in enumerate(names):
        facts = exact_quantiles(df, keys, c, (0.25, 0.75), "floor", accuracy, ("q1", "q3"))
        held = attach(held, facts, keys, f"_q{i}", raw=True)

    def outside(i: int, c: str) -> Column:
        q1, q3, v = F.col(f"_q{i}.q1"), F.col(f"_q{i}.q3"), F.col(c)
        reach = threshold * (q3 - q1)
        hit = (v < q1 - reach) | (v > q3 + reach)
        return F.when(hit, F.struct(F.lit(c).alias("column_name"), v.cast("double").alias("value")))

    found = F.filter(F.array(*[outside(i, c) for i, c in enumerate(names)]), lambda x: x.isNotNull())
    return held.select(*keys, *row_id, F.explode(found).alias("_o")).select(*keys, *row_id, "_o.*")


# ---- treatment -----------------------------------------------------------------

def drop_diagnostics(df: DataFrame) -> DataFrame:
    """Remove the detection columns."""
    return df.drop(*[c for c in df.columns if "outlier" in c.lower() or c in ("seasonal_zscore", "rolling_zscore")])


def remove_outliers(df: DataFrame, flag: str = "is_outlier_consensus") -> DataFrame:
    return drop_diagnostics(df.where(~F.col(flag)))


def interpolate_outliers(
    df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y", flag: str = "is_outlier_consensus"
) -> DataFrame:
    """Replace outliers by the straight line in time between the nearest good points.

    Before the first good point the value stays null; after the last it is the last good value.
    """
    # each side by a frame that grows: Spark goes through a frame that shrinks again for every row; rows of one time see each other
    past, ahead = (w.rangeBetween(Window.unboundedPreceding, Window.currentRow) for w in (by_time(keys, ts), by_time(keys, F.col(ts).desc())))
    kept = F.when(~F.col(flag), F.col(y))
    seconds = clock_seconds(ts)
    point = F.when(kept.isNotNull(), F.struct(seconds.alias("t"), kept.alias("v")))
    held = df.withColumns(
        {
            "_t": seconds,
            "_kept": kept,
            "_a": F.last(point, True).over(past),
            "_b": F.last(point, True).over(ahead),
        }
    )
    share = ratio((F.col("_t") - F.col("_a.t")).cast("double"), (F.col("_b.t") - F.col("_a.t")).cast("double"))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * share
    filled = F.coalesce("_kept", line, F.col("_a.v"))
    return drop_diagnostics(held.withColumn(y, filled).drop("_t", "_kept", "_a", "_b"))


def winsorize(
    df: DataFrame,
    keys: Sequence[str] = (),
    y: str = "y",
    low: float = 0.05,
    high: float = 0.95,
    scale: str = "series",
    accuracy: int = 10_000,
) -> DataFrame:
    """Clip all values to the low and high quantile, whatever the flags say."""
    held, (lo, hi) = _with_quantiles(df, keys, y, (low, high), scale, accuracy)
    clipped = F.when(F.col(y).isNotNull(), F.least(F.greatest(F.col(y), lo), hi))
    return drop_diagnostics(held.withColumn(y, clipped).drop("_q"))


def treat_outliers(
    df: DataFrame, method: str = "interpolate", keys: Sequence[str] = (), ts: str = "ts", y: str = "y"
) -> DataFrame:
    """remove, interpolate or winsorize; without a consensus column the frame is returned unchanged."""
    if "is_outlier_consensus" not in df.columns:
        return df
    if method == "remove":
        return remove_outliers(df)
    if method == "interpolate":
        return interpolate_outliers(df, keys, ts, y)
    if method == "winsorize":
        return winsorize(df, keys, y)
    raise ValueError(f"unsupported treatment {method!r}; remove, interpolate or winsorize")
