"""Combining forecasts held in one long table (keys…, model, step, ds, yhat, lower, upper)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import attach, known, per_series, ratio

# Fixed value: half width of the fallback interval in standard deviations.
Z95 = 1.96


def _complete_steps(grouped: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only steps every contributing model reaches, so members of different length are cut alike."""
    most = F.max("n_models").over(per_series(keys))
    return grouped.withColumn("_most", most).where(F.col("n_models") == F.col("_most")).drop("_most")


def simple_average(forecasts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    grouped = forecasts.where(known("yhat")).groupBy(*keys, "step", "ds").agg(
        F.count("*").alias("n_models"), F.avg("yhat").alias("yhat")
    )
    return _complete_steps(grouped, keys)


def ensemble_weights(
    scores: DataFrame, keys: Sequence[str] = (), given: Mapping[str, float] | None = None, method: str = "auto"
) -> DataFrame:
    """(keys, model, weight), summing to 1 per key.

    ``auto``: 1 / (mape + 1); a member without a score or with a failed status
    weighs 0. ``equal`` and a ``given`` mapping are the alternatives. If every
    member weighs 0 they share equally.
    """
    if given is not None:
        raw: Column = F.lit(0.0)
        for model, w in given.items():
            raw = F.when(F.col("model") == model, F.lit(float(w))).otherwise(raw)
    elif method == "equal":
        raw = F.lit(1.0)
    elif method == "auto":
        ok = F.col("status") == "success" if "status" in scores.columns else F.lit(True)
        raw = F.when(ok & known("mape"), 1.0 / (F.col("mape") + 1.0)).otherwise(0.0)
    else:
        raise ValueError(f"unknown weighting {method!r}")
    whole = per_series(keys)
    held = scores.withColumn("_raw", raw)
    share = ratio(F.col("_raw"), F.sum("_raw").over(whole))
    weight = F.coalesce(share, 1.0 / F.count("*").over(whole))
    return held.select(*keys, "model", weight.alias("weight"))


def weighted_average(
    forecasts: DataFrame, weights: DataFrame, keys: Sequence[str] = (), intervals: bool = False
) -> DataFrame:
    """sum(w * yhat) / sum(w) per step, over members with a weight above 0; optionally the same for the bounds.

    Without any bounds the interval is the members' mean -/+ 1.96 population stds.
    """
    rows = attach(forecasts.where(known("yhat")), weights, [*keys, "model"], "_w")
    rows = rows.withColumn("_wt", F.col("_w.weight")).where(F.col("_wt") > 0)
    aggs = [
        F.count("*").alias("n_models"),
        ratio(F.sum(F.col("_wt") * F.col("yhat")), F.sum("_wt")).alias("yhat"),
    ]
    if intervals:
        both = known("lower") & known("upper")

        def bound(c: str, sign: int) -> Column:
            weighted = ratio(F.sum(F.when(both, F.col("_wt") * F.col(c))), F.sum(F.when(both, F.col("_wt"))))
            return F.coalesce(weighted, F.avg("yhat") + sign * Z95 * F.stddev_pop("yhat")).alias(c)

        aggs += [bound("lower", -1), bound("upper", 1)]
    return _complete_steps(rows.groupBy(*keys, "step", "ds").agg(*aggs), keys)


def ensemble_intervals(forecasts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Members' mean -/+ 1.96 population stds per step: the interval when members give none."""
    spread = F.stddev_pop("yhat") * Z95
    grouped = forecasts.where(known("yhat")).groupBy(*keys, "step", "ds").agg(
        F.count("*").alias("n_models"),
        F.avg("yhat").alias("yhat"),
        (F.avg("yhat") - spread).alias("lower"),
        (F.avg("yhat") + spread).alias("upper"),
    )
    return _complete_steps(grouped, keys)


def contributions(scores: DataFrame, weights: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each member's status, hold-out scores and weight."""
    rest = [c for c in scores.columns if c not in (*keys, "model")]
    joined = attach(scores, weights, [*keys, "model"], "_w")
    order = Window.partitionBy(*keys).orderBy(F.desc("weight"), "model")
    return joined.select(*keys, "model", *rest, F.col("_w.weight").alias("weight")).withColumn(
        "weight_rank", F.row_number().over(order)
    )
