"""Expanding-window cross-validation and hold-out splits over panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_time, match
from .metrics import basic_aggregates
from .trend import indexed


def _initial(initial: int | None) -> Column:
    return F.lit(initial) if initial is not None else F.floor(F.col("n") / 2).cast("int")


def fold_cuts(
    df: DataFrame, keys: Sequence[str] = (), initial: int | None = None, horizon: int = 1, step: int = 1
) -> DataFrame:
    """(keys, fold, cut, n): training is idx < cut, testing cut <= idx < cut + horizon.

    The first cut is ``initial`` rows, half the series unless given; series too
    short for one fold give none.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    last = F.col("n") - horizon
    cuts = F.when(last >= _initial(initial), F.sequence(_initial(initial), last.cast("int"), F.lit(step)))
    return sizes.select(*keys, "n", F.posexplode(cuts).alias("fold", "cut"))


def fold_tests(
    df: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "ts",
    initial: int | None = None,
    horizon: int = 1,
    step: int = 1,
) -> DataFrame:
    """Test rows of every fold: (…, idx, n, fold, cut).

    A row finds its folds by arithmetic on its index, so no range join is
    needed: it is emitted once per fold it is tested in, at most
    ceil(horizon / step) times.
    """
    rows = indexed(df, keys, ts).withColumn("_first", _initial(initial))
    past = F.col("idx") - F.col("_first")
    low = F.greatest(F.lit(0), F.ceil((past - horizon + 1) / step)).cast("int")
    top = F.floor((F.col("n") - horizon - F.col("_first")) / step)
    high = F.least(F.floor(past / step), top).cast("int")
    folds = F.when((past >= 0) & (high >= low), F.sequence(low, high))
    return (
        rows.withColumn("fold", F.explode(folds))
        .withColumn("cut", (F.col("_first") + F.col("fold") * step).cast("int"))
        .drop("_first")
    )


def fold_train(
    df: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "ts",
    initial: int | None = None,
    horizon: int = 1,
    step: int = 1,
) -> DataFrame:
    """The training rows of every fold, with ``fold``: a panel keyed by (keys, fold) that any model can be run on.

    A row finds the folds it trains by arithmetic on its index. The frame grows
    with the number of folds, as refitting does; it is made from reduced series.
    """
    rows = indexed(df, keys, ts).withColumn("_first", _initial(initial))
    room = F.col("n") - horizon - F.col("_first")
    low = F.greatest(F.lit(0), F.ceil((F.col("idx") + 1 - F.col("_first")) / step)).cast("int")
    high = F.floor(room / step).cast("int")
    folds = F.when((room >= 0) & (high >= low), F.sequence(low, high))
    return rows.withColumn("fold", F.explode(folds)).drop("idx", "n", "_first")


def cv_linear_trend(
    df: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "ts",
    y: str = "y",
    initial: int | None = None,
    horizon: int = 6,
    step: int = 3,
) -> DataFrame:
    """(keys, fold, cut, ts, y, yhat) of the linear trend refitted at every cut.

    The fit of every possible cut is one running regression window, so all
    folds cost one pass; the fold's line meets its test rows by an equi-join on
    (keys, cut).
    """
    x = F.col("idx").cast("double")
    upto = by_time(keys, ts).rowsBetween(Window.unboundedPreceding, 0)
    lines = indexed(df, keys, ts).select(
        *keys,
        (F.col("idx") + 1).alias("cut"),
        F.regr_slope(F.col(y), x).over(upto).alias("_slope"),
        F.regr_intercept(F.col(y), x).over(upto).alias("_intercept"),
    )
    tests = fold_tests(df, keys, ts, initial, horizon, step)
    return (
        match(tests, lines, [*keys, "cut"])
        .withColumn("yhat", F.col("_intercept") + F.col("_slope") * F.col("idx"))
        .select(*keys, "fold", "cut", ts, F.col(y).alias("y"), "yhat")
    )


def cv_scores(predicted: DataFrame, by: Sequence[str] = (), metrics: Sequence[str] = ("mae", "rmse", "mape")) -> DataFrame:
    """Mean and population std over folds of the fold metrics, with the number of folds."""
    aggs = basic_aggregates()
    folds = predicted.groupBy(*by, "fold").agg(*[aggs[m].alias(m) for m in metrics])
    out = [F.count("*").alias("n_folds")]
    for m in metrics:
        out += [F.avg(m).alias(f"avg_{m}"), F.stddev_pop(m).alias(f"std_{m}")]
    return folds.groupBy(*by).agg(*out)


def cv_cutoffs(
    df: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "ts",
    initial: int = 730,
    period: int = 180,
    horizon: int = 365,
) -> DataFrame:
    """(keys, cutoff, horizon_end): cutoffs in days, back from last - horizon while initial days remain before them."""
    span = df.groupBy(*keys).agg(F.to_date(F.min(ts)).alias("_lo"), F.to_date(F.max(ts)).alias("_hi"))
    room = F.date_diff("_hi", "_lo") - horizon - initial
    count = F.when(room >= 0, F.sequence(F.lit(0), F.floor(room / period).cast("int")))
    cutoff = F.date_sub(F.col("_hi"), F.lit(horizon) + F.col("_k") * period)
    return (
        span.withColumn("_k", F.explode(count))
        .select(*keys, cutoff.alias("cutoff"))
        .withColumn("horizon_end", F.date_add("cutoff", horizon))
    )


def cutoff_parts(
    df: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "ts",
    initial: int = 730,
    period: int = 180,
    horizon: int = 365,
) -> tuple[DataFrame, DataFrame]:
    """(training, test) rows of every cutoff of :func:`cv_cutoffs`, with ``fold`` counted back from the newest.

    Training is ts <= cutoff, testing the ``horizon`` days after it, with ``step``
    numbering a fold's test rows from 1.
    """
    whole = Window.partitionBy(*keys)
    day = F.unix_date(F.to_date(ts))
    placed = df.withColumns({"_lo": F.min(day).over(whole), "_hi": F.max(day).over(whole), "_day": day})
    last = F.floor((F.col("_hi") - F.col("_lo") - horizon - initial) / period).cast("int")
    back = F.col("_hi") - horizon - F.col("_day")  # cutoff k lies at or after the row while k * period <= back
    upto = F.least(F.floor(back / period).cast("int"), last)
    train = placed.withColumn("fold", F.explode(F.when(upto >= 0, F.sequence(F.lit(0), upto))))
    low = F.greatest(F.floor(back / period).cast("int") + 1, F.lit(0))
    high = F.least(F.floor((F.col("_hi") - F.col("_day")) / period).cast("int"), last)
    test = placed.withColumn("fold", F.explode(F.when(high >= low, F.sequence(low, high))))
    order = Window.partitionBy(*keys, "fold").orderBy(ts)
    extras = ("_lo", "_hi", "_day")
    return train.drop(*extras), test.withColumn("step", F.row_number().over(order)).drop(*extras)


def holdout_split(
    df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", share: float = 0.8
) -> DataFrame:
    """Add idx, n, split = floor(share * n) and is_train."""
    rows = indexed(df, keys, ts).withColumn("split", F.floor(F.col("n") * F.lit(share)).cast("int"))
    return rows.withColumn("is_train", F.col("idx") < F.col("split"))


def series_eligibility(df: DataFrame, keys: Sequence[str] = (), min_rows: int = 24) -> DataFrame:
    """Which series are long enough to train on; short ones are reported, never raised."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("n_rows"))
        .withColumn("eligible", F.col("n_rows") >= min_rows)
        .withColumn("status", F.when(F.col("eligible"), "ok").otherwise(f"needs {min_rows} rows"))
    )
