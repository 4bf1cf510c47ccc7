"""Regular calendars: resampling, gap filling, future periods, calendar features."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by_time, col, period_end, period_start, period_step, shift_periods


def resample(
    df: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "ts",
    y: str | Column = "y",
    freq: str = "M",
    digits: int | None = None,
    dense: bool = True,
) -> DataFrame:
    """Sum per period, labelled with the period's last day; empty periods inside a series sum to 0.

    One partial + final aggregate reduces the raw rows, so a hot key or period
    costs no more than any other. ``digits`` rounds the sums, which makes them
    independent of the order of addition.
    """
    total = F.coalesce(F.sum(col(y).cast("double")), F.lit(0.0))
    if digits is not None:
        total = F.round(total, digits)
    sums = (
        df.where(F.col(ts).isNotNull())
        .groupBy(*keys, period_end(ts, freq).alias("_period"))
        .agg(total.alias("_sum"))
        .select(*keys, F.col("_period").alias("ts"), F.col("_sum").alias("y"))
    )
    return densify(sums, keys, freq) if dense else sums


def densify(df: DataFrame, keys: Sequence[str] = (), freq: str = "M", fill: float = 0.0) -> DataFrame:
    """Add the periods missing between a series' first and last, with value ``fill``.

    Each row also emits the empty periods up to the next one, so no calendar
    table, join or second aggregate is needed.
    """
    w = by_time(keys)
    here = period_start("ts", freq)
    following = F.lead("ts").over(w)
    upto = F.coalesce(shift_periods(period_start(following, freq), freq, -1), here)
    spread = df.select(*keys, "y", F.sequence(here, upto, period_step(freq)).alias("_starts"))
    rows = spread.select(*keys, "y", F.posexplode("_starts").alias("_pos", "_start"))
    return rows.select(
        *keys,
        period_end("_start", freq).alias("ts"),
        F.when(F.col("_pos") == 0, F.col("y")).otherwise(F.lit(fill)).alias("y"),
    )


def closed_periods(df: DataFrame, raw: DataFrame, raw_ts: str, freq: str = "M") -> DataFrame:
    """Drop the period that the data only partly covers: the one holding the latest raw time,
    unless that time is the period's last day."""
    as_of = raw.agg(F.to_date(F.max(raw_ts)).alias("as_of")).scalar()
    return df.withColumn("_as_of", as_of).where(F.col("ts") <= F.col("_as_of")).drop("_as_of")


def future_calendar(
    df: DataFrame, horizon: int, keys: Sequence[str] = (), ts: str = "ts", freq: str = "M"
) -> DataFrame:
    """(keys, step, ds): the next ``horizon`` period ends after each series' last time."""
    last = df.groupBy(*keys).agg(F.max(ts).alias("_last"))
    steps = last.select(*keys, "_last", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    nxt = shift_periods(period_start("_last", freq), freq, F.col("step"))
    return steps.select(*keys, "step", period_end(nxt, freq).alias("ds"))


def season_columns(ts: str | Column) -> dict[str, Column]:
    """Calendar parts, their cyclic encodings and the season flags of a time."""
    d = col(ts)
    month, quarter = F.month(d), F.quarter(d)

    def wave(fn, part: Column, period: int) -> Column:
        return fn(part * F.lit(2 * math.pi / period))

    return {
        "year": F.year(d),
        "month": month,
        "quarter": quarter,
        "day_of_year": F.dayofyear(d),
        "week_of_year": F.weekofyear(d),
        "month_sin": wave(F.sin, month, 12),
        "month_cos": wave(F.cos, month, 12),
        "quarter_sin": wave(F.sin, quarter, 4),
        "quarter_cos": wave(F.cos, quarter, 4),
        "is_holiday_season": month.isin(12, 1).cast("int"),
        "is_summer": month.between(6, 8).cast("int"),
    }


def seasonal_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Eleven calendar features; row-local, no shuffle."""
    return df.withColumns(season_columns(ts))
