"""Look-back forecaster: boosted trees on each series' last scaled values, one model over the panel."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by_time, match, per_series, ratio
from ..session import settle
from .features import lookback_sequences
from .packing import month_ends, pack_series

Z95 = 1.96


def scaled_panel(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y") -> DataFrame:
    """Min-max scale every series to 0..1; keeps ``low`` and ``span`` for the way back. Constant series are 0."""
    whole = per_series(keys)
    held = df.select(*keys, ts, F.col(y).cast("double").alias("_raw")).withColumns(
        {"low": F.min("_raw").over(whole), "span": F.max("_raw").over(whole) - F.min("_raw").over(whole)}
    )
    return held.select(*keys, ts, "low", "span", F.coalesce(ratio(F.col("_raw") - F.col("low"), F.col("span")), F.lit(0.0)).alias("y"))


@dataclass
class LookbackModel:
    """A fitted model with its validation error (share of a series' span) per series."""

    model: GBTRegressionModel
    lookback: int
    validation: DataFrame


def lookback_fit(
    df: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "ts",
    y: str = "y",
    lookback: int = 12,
    validation_share: float = 0.2,
    max_iter: int = 20,
    max_depth: int = 4,
    seed: int = 42,
) -> LookbackModel:
    """Train on the first windows of every series, validate on its last ``validation_share``.

    The split is by time within each series. Training is pooled, so it costs the
    same passes however many series there are.
    """
    scaled = scaled_panel(df, keys, ts, y)
    windows = lookback_sequences(scaled, keys, ts, "y", lookback)
    place, total = F.row_number().over(by_time(keys, ts)), F.count("*").over(per_series(keys))
    split = windows.withColumn("_late", place > F.floor(total * (1 - validation_share))).select(
        *keys, ts, "target", "_late", array_to_vector("window").alias("features")
    )
    estimator = GBTRegressor(
        featuresCol="features", labelCol="target", maxIter=max_iter, maxDepth=max_depth, seed=seed, cacheNodeIds=True
    )
    model = estimator.fit(split.where(~F.col("_late")).select("features", "target"))
    checked = model.transform(split.where("_late"))
    validation = checked.groupBy(*keys).agg(
        F.count("*").alias("n_validation"),
        F.sqrt(F.avg(F.pow(F.col("target") - F.col("prediction"), 2.0))).alias("rmse_scaled"),
    )
    return LookbackModel(model, lookback, validation)


def lookback_forecast(
    df: DataFrame, keys: Sequence[str] = (), horizon: int = 12, ts: str = "ts", y: str = "y", fitted: LookbackModel | None = None, **options
) -> DataFrame:
    """(keys, step, ds, yhat, lower, upper): predictions feed the window of the next step.

    The recursion is a chain of row-local projections over one row per series:
    no shuffle or job per step. Bounds use the validation error in the series'
    own units.
    """
    df = settle(df.select(*keys, ts, y))
    trained = fitted or lookback_fit(df, keys, ts, y, **options)
    scaled = scaled_panel(df, keys, ts, y)
    state = pack_series(scaled, keys, ts, ("y", "low", "span"))
    n = trained.lookback
    rows = state.where(F.size("y") >= n).select(
        *keys,
        "last_ts",
        F.element_at("low", 1).alias("low"),
        F.element_at("span", 1).alias("span"),
        F.slice("y", -n, n).alias("window"),
    )
    for h in range(1, horizon + 1):
        scored = trained.model.transform(rows.withColumn("features", array_to_vector("window")))
        rows = scored.withColumn("window", F.slice(F.concat("window", F.array("prediction")), 2, n)).withColumnRenamed(
            "prediction", f"_p{h}"
        ).drop("features")
    steps = F.array(*[F.struct(F.lit(h).alias("step"), F.col(f"_p{h}").alias("p")) for h in range(1, horizon + 1)])
    long = rows.select(*keys, "last_ts", "low", "span", F.explode(steps).alias("_s"))
    if keys:
        held = match(long, trained.validation, keys, "left")
    else:
        held = long.withColumn("rmse_scaled", trained.validation.select("rmse_scaled").scalar())
    yhat = F.col("low") + F.col("_s.p") * F.col("span")
    half = F.col("rmse_scaled") * F.col("span") * Z95
    out = held.select(*keys, "last_ts", F.col("_s.step").alias("step"), yhat.alias("yhat"), (yhat - half).alias("lower"), (yhat + half).alias("upper"))
    return month_ends(out).select(*keys, "step", "ds", "yhat", "lower", "upper")
