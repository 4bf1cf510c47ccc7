"""Regressor columns of the additive model: Fourier terms, trend hinges, holidays."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import per_series, period_end, ratio

# Period in days and Fourier order of each seasonality.
SEASONALITIES = {
    "yearly": (365.25, 10),
    "monthly": (30.5, 5),
    "quarterly": (91.25, 4),
    "weekly": (7.0, 3),
}


def epoch_days(ts: str | Column) -> Column:
    return F.unix_date(F.to_date(ts))


def fourier_columns(ts: str, seasonalities: Mapping[str, tuple[float, int]]) -> dict[str, Column]:
    """sin and cos of 2 pi k t / period for k = 1..order, t in days since 1970."""
    out: dict[str, Column] = {}
    for name, (period, order) in seasonalities.items():
        for k in range(1, order + 1):
            angle = epoch_days(ts) * F.lit(2 * math.pi * k / period)
            out[f"{name}_sin_{k}"] = F.sin(angle)
            out[f"{name}_cos_{k}"] = F.cos(angle)
    return out


def fourier_features(df: DataFrame, seasonalities: Mapping[str, tuple[float, int]] = SEASONALITIES, ts: str = "ts") -> DataFrame:
    return df.withColumns(fourier_columns(ts, seasonalities))


def hinge_positions(count: int, share: float = 0.8) -> list[float]:
    """``count`` changepoints spread evenly over the first ``share`` of the series, the start left out."""
    return [share * (i + 1) / count for i in range(count)]


def changepoint_features(
    df: DataFrame, count: int = 25, keys: Sequence[str] = (), ts: str = "ts", share: float = 0.8
) -> DataFrame:
    """Scaled time t in 0..1 of each series and max(t - c, 0) for every changepoint c."""
    day, whole = epoch_days(ts), per_series(keys)
    first, last = F.min(day).over(whole), F.max(day).over(whole)
    timed = df.withColumn("t", F.coalesce(ratio((day - first).cast("double"), (last - first).cast("double")), F.lit(0.0)))
    hinges = {f"hinge_{i + 1}": F.greatest(F.col("t") - c, F.lit(0.0)) for i, c in enumerate(hinge_positions(count, share))}
    return timed.withColumns(hinges)


def holiday_join(df: DataFrame, holidays: DataFrame, ts: str = "ts", ds: str = "ds") -> DataFrame:
    """Left join a holiday table (ds, holiday) on the day, and add ``is_holiday``.

    Several holidays of a day are named in order, with commas. The table comes from the user, so whether it is broadcast is decided by
    its size, by Spark.
    """
    named = holidays.select(F.to_date(ds).alias("_ds"), "holiday").groupBy("_ds").agg(
        F.array_join(F.array_sort(F.collect_set("holiday")), ", ").alias("holiday")
    )
    joined = df.join(named, F.to_date(df[ts]) == F.col("_ds"), "left").drop("_ds")
    return joined.withColumn("is_holiday", F.col("holiday").isNotNull().cast("int"))


def holiday_regressors(
    df: DataFrame, holidays: DataFrame, names: Sequence[str], ts: str = "ts", ds: str = "ds", freq: str = "D"
) -> DataFrame:
    """One column per named holiday: how many of its days fall in the row's day, week, month, quarter or year (D, W, M, Q, Y)."""

    def grain(c):
        return period_end(F.to_date(c), freq)

    counts = holidays.groupBy(grain(ds).alias("_ds")).agg(
        *[F.count_if(F.col("holiday") == n).cast("double").alias(f"holiday_{n}") for n in names]
    )
    joined = df.join(counts, grain(df[ts]) == F.col("_ds"), "left").drop("_ds")
    return joined.na.fill(0.0, [f"holiday_{n}" for n in names])
