"""What-if paths over the next periods of each series.

Each path is computed from one row of per-series facts exploded over the
steps, so the work after the fit is row-local.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import period_end, period_start, ratio, shift_periods
from .trend import indexed

# Months boosted unless told otherwise, and the horizon of a scenario.
BOOST_MONTHS = (11, 12)
HORIZON = 12


def path_facts(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y", tail: int = 12) -> DataFrame:
    """Last time, last value and the slope of the last ``tail`` rows, one row per series, in one aggregate."""
    rows = indexed(df, keys, ts)
    near = F.when(F.col("idx") >= F.col("n") - tail, F.col(y))
    return rows.groupBy(*keys).agg(
        F.max(ts).alias("last_ts"),
        F.max_by(y, ts).alias("last_value"),
        F.regr_slope(near, F.col("idx").cast("double")).alias("slope"),
    )


def season_factor(step: Column, month: Column) -> Column:
    """1 + 0.1 sin(2 pi (step - 1 + month) / 12)."""
    return 1 + 0.1 * F.sin((step - 1 + month) * F.lit(2 * math.pi / 12))


def base_path(
    df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y", horizon: int = HORIZON
) -> DataFrame:
    """(keys, step, ds, base, last_value, slope): the recent slope continued with a mild seasonal swing."""
    steps = path_facts(df, keys, ts, y).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    step, month = F.col("step"), F.month("last_ts")
    base = F.col("last_value") + step * F.col("slope") * season_factor(step, month)
    ds = period_end(shift_periods(period_start("last_ts", "M"), "M", step), "M")
    return steps.select(*keys, "step", ds.alias("ds"), base.alias("base"), "last_value", "slope")


def growth_scenario(path: DataFrame, percent: float) -> DataFrame:
    """The base path scaled up evenly to ``percent`` after a year."""
    return path.withColumn("scenario", F.col("base") * (1 + F.lit(percent / 100) * F.col("step") / 12))


def seasonal_scenario(path: DataFrame, percent: float, months: Sequence[int] = BOOST_MONTHS) -> DataFrame:
    """The base path with the given calendar months raised by ``percent``."""
    boosted = F.month("ds").isin(*months)
    return path.withColumn("scenario", F.when(boosted, F.col("base") * (1 + percent / 100)).otherwise(F.col("base")))


def trend_scenario(path: DataFrame, slope: float | Column | None = None) -> DataFrame:
    """A straight line from the last value with a new slope (the recent slope unless given)."""
    s = F.col("slope") if slope is None else (F.lit(float(slope)) if isinstance(slope, (int, float)) else slope)
    return path.withColumn("scenario", F.col("last_value") + F.col("step") * s)


def scenario(path: DataFrame, kind: str = "growth_rate", **parameters) -> DataFrame:
    """Dispatch by kind: growth_rate (percent), seasonal_adjustment (percent, months), trend_change (slope)."""
    if kind == "growth_rate":
        return growth_scenario(path, parameters.get("percent", 0.0))
    if kind == "seasonal_adjustment":
        return seasonal_scenario(path, parameters.get("percent", 0.0), parameters.get("months", BOOST_MONTHS))
    if kind == "trend_change":
        return trend_scenario(path, parameters.get("slope"))
    raise ValueError(f"unsupported scenario {kind!r}")


def scenario_impact(path: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals, absolute and % impact, and the recommendation label of a scenario."""
    totals = path.groupBy(*keys).agg(
        F.sum("base").alias("total_base"), F.sum("scenario").alias("total_scenario")
    )
    diff = F.col("total_scenario") - F.col("total_base")
    pct = F.col("percentage_impact")
    # Fixed values below: the 5 % limits and the labels.
    return totals.withColumns(
        {"absolute_impact": diff, "percentage_impact": ratio(diff * 100.0, F.col("total_base"))}
    ).withColumns(
        {
            "direction": F.when(pct > 0, "Positive").otherwise("Negative"),
            "recommendation": F.when(pct > 5, "Favorable scenario")
            .when(F.abs(pct) <= 5, "Neutral impact")
            .otherwise("Challenging scenario"),
        }
    )


def monthly_differences(path: DataFrame) -> DataFrame:
    return path.withColumn("difference", F.col("scenario") - F.col("base"))
