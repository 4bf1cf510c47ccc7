"""Trend, decomposition, KPIs and forecast summary of reduced series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_time, change_rate, per_series, ratio
from . import profile


def indexed(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Add ``idx`` (0, 1, …) and ``n`` of each series."""
    return df.withColumns(
        {"idx": F.row_number().over(by_time(keys, ts)) - 1, "n": F.count("*").over(per_series(keys))}
    )


def slope_label(slope: Column) -> Column:
    return F.when(slope > 0, "increasing").when(slope < 0, "decreasing").otherwise("stable")


def trend_fit(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y", last: int | None = None) -> DataFrame:
    """Least-squares slope and intercept against the row index, of the whole series or its last rows.

    Over the last rows the index starts again at 0.
    """
    rows = indexed(df, keys, ts)
    if last is not None:
        start = F.greatest(F.col("n") - last, F.lit(0))
        rows = rows.where(F.col("idx") >= start).withColumn("idx", F.col("idx") - start)
    x = F.col("idx").cast("double")
    return rows.groupBy(*keys).agg(
        F.regr_slope(F.col(y), x).alias("slope"), F.regr_intercept(F.col(y), x).alias("intercept")
    )


def linear_trend(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y") -> DataFrame:
    """Each row with its index and fitted value, and the series' slope, intercept and label.

    Slope and intercept are window aggregates over the indexed series: no join.
    """
    whole = per_series(keys)
    x = F.col("idx").cast("double")
    fitted = indexed(df, keys, ts).withColumns(
        {
            "slope": F.regr_slope(F.col(y), x).over(whole),
            "intercept": F.regr_intercept(F.col(y), x).over(whole),
        }
    )
    return fitted.withColumns(
        {"trend_line": F.col("intercept") + F.col("slope") * x, "interpretation": slope_label(F.col("slope"))}
    ).drop("n")


def growth_rates(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y") -> DataFrame:
    """Mean, sample std, mean of the last 3 and of the last 12 period-on-period changes (null under 12)."""
    w = by_time(keys, ts)
    changes = df.select(*keys, ts, change_rate(F.col(y), F.lag(y).over(w)).alias("g")).where(F.col("g").isNotNull())
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ts)))
    ranked = changes.withColumn("_back", back)
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("n_growth"),
        F.avg("g").alias("mean_growth"),
        F.stddev_samp("g").alias("std_growth"),
        F.avg(F.when(F.col("_back") <= 3, F.col("g"))).alias("recent_3"),
        F.when(F.count("*") >= 12, F.avg(F.when(F.col("_back") <= 12, F.col("g")))).alias("recent_12"),
    )


def trend_analysis(
    df: DataFrame, kind: str = "comprehensive", keys: Sequence[str] = (), ts: str = "ts", y: str = "y"
) -> dict[str, DataFrame]:
    """The named parts of a trend analysis as lazy frames: trend, seasonal or comprehensive (both and yearly)."""
    if kind not in ("comprehensive", "trend", "seasonal"):
        raise ValueError(f"unsupported analysis {kind!r}")
    parts: dict[str, DataFrame] = {}
    if kind != "seasonal":
        parts["linear_trend"] = linear_trend(df, keys, ts, y)
        parts["growth_rates"] = growth_rates(df, keys, ts, y)
    if kind != "trend":
        parts["monthly_pattern"] = profile.seasonal_profile(df, keys, ts, y, "month")
        parts["quarterly_pattern"] = profile.seasonal_profile(df, keys, ts, y, "quarter")
        parts["seasonality"] = profile.seasonality_strength(df, keys, ts, y)
    if kind == "comprehensive":
        parts["yearly_growth"] = profile.yearly_growth(df, keys, ts, y)
    return parts


def decompose(
    df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y", model: str = "additive", period: int = 12
) -> DataFrame:
    """(keys, ts, observed, trend, seasonal, residual): classical decomposition, nulls kept at the edges.

    Trend is the centred moving average (half weights at both ends for an even
    period); seasonal is the mean detrended value of each position in the
    cycle, re-centred to mean 0 (or 1). Series shorter than two periods give null.
    """
    if model not in ("additive", "multiplicative"):
        raise ValueError(f"unsupported model {model!r}; additive or multiplicative")
    w = by_time(keys, ts)
    half = period // 2
    v = F.col(y)
    if period % 2:
        frame = w.rowsBetween(-half, half)
        total, full = F.sum(v).over(frame), F.count(v).over(frame) == period
    else:
        wide, core = w.rowsBetween(-half, half), w.rowsBetween(-(half - 1), half - 1)
        ends = (F.lag(y, half).over(w) + F.lead(y, half).over(w)) * 0.5
        total, full = F.sum(v).over(core) + ends, F.count(v).over(wide) == period + 1
    enough = F.count("*").over(per_series(keys)) >= 2 * period
    trend = F.when(full & enough, total / period)
    based = df.select(
        *keys, ts, v.alias("observed"), trend.alias("trend"), ((F.row_number().over(w) - 1) % period).alias("_pos")
    )
    additive = model == "additive"
    rest = F.col("observed") - F.col("trend") if additive else ratio(F.col("observed"), F.col("trend"))
    by_position = Window.partitionBy(*keys, "_pos")
    means = based.withColumn("_rest", rest).withColumn("_mean", F.avg("_rest").over(by_position))
    # the mean over the positions, each counted once
    once = F.when(F.row_number().over(by_position.orderBy(ts)) == 1, F.col("_mean"))
    centred = means.withColumn("_once", once).withColumn("_center", F.avg("_once").over(per_series(keys)))
    if additive:
        seasonal = F.col("_mean") - F.col("_center")
        residual = F.col("observed") - F.col("trend") - F.col("seasonal")
    else:
        seasonal = ratio(F.col("_mean"), F.col("_center"))
        residual = ratio(F.col("observed"), F.col("trend") * F.col("seasonal"))
    return (
        centred.withColumn("seasonal", seasonal)
        .withColumn("residual", residual)
        .select(*keys, ts, "observed", "trend", "seasonal", "residual")
    )


def component_shares(df: DataFrame, components: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, component, variance, importance): each component's sample variance and its % of their total."""
    wide = df.groupBy(*keys).agg(*[F.var_samp(c).alias(c) for c in components])
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in components), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("variance")) for c in components])
    return wide.select(*keys, total.alias("_total"), F.explode(rows).alias("_r")).select(
        *keys,
        "_r.component",
        "_r.variance",
        ratio(F.col("_r.variance") * 100.0, F.col("_total")).alias("importance"),
    )


def kpis(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y") -> DataFrame:
    """Latest value, MoM %, YoY % (needs 13 rows), mean, 6-row slope and direction, volatility %, accuracy and levels.

    One window pass numbers the rows from the end; everything else is one aggregate.
    """
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ts)))
    rows = df.select(*keys, ts, F.col(y).alias("_y"), back.alias("_back"))

    def nth(k: int) -> Column:
        return F.max(F.when(F.col("_back") == k, F.col("_y")))

    recent = F.when(F.col("_back") <= 6, F.col("_y"))
    facts = rows.groupBy(*keys).agg(
        F.count("*").alias("total_periods"),
        F.min(ts).alias("start_ts"),
        F.max(ts).alias("end_ts"),
        nth(1).alias("current_value"),
        F.coalesce(nth(2), nth(1)).alias("previous_value"),
        nth(13).alias("_year_ago"),
        F.avg("_y").alias("avg_value"),
        F.regr_slope(recent, -F.col("_back").cast("double")).alias("recent_slope"),
        ratio(F.stddev_samp("_y") * 100.0, F.avg("_y")).alias("volatility"),
    )
    return grade_kpis(facts)


def grade_kpis(facts: DataFrame) -> DataFrame:
    """Growth rates, directions and levels from a key's facts, ``_year_ago`` among them, which goes."""
    now, accuracy = F.col("current_value"), F.greatest(F.lit(70.0), 100 - F.abs("volatility") / 2)

    def arrow(c: str) -> Column:
        return F.when(F.col(c) > 0, "up").when(F.col(c) < 0, "down").otherwise("neutral")

    graded = facts.withColumns(
        {
            "mom_growth": change_rate(now, F.col("previous_value")) * 100,
            "yoy_growth": change_rate(now, F.col("_year_ago")) * 100,
            "trend_direction": slope_label(F.col("recent_slope")),
            "forecast_accuracy": accuracy,
        }
    )
    return graded.withColumns(
        {
            "mom_trend": arrow("mom_growth"),
            "yoy_trend": arrow("yoy_growth"),
            "volatility_level": F.when(F.col("volatility") > 20, "high").when(F.col("volatility") > 10, "medium").otherwise("low"),
            "accuracy_level": F.when(accuracy > 90, "excellent").when(accuracy > 80, "good").otherwise("fair"),
        }
    ).drop("_year_ago")


def forecast_summary(df: DataFrame, keys: Sequence[str] = (), step: str = "step", yhat: str = "yhat") -> DataFrame:
    """First-to-last growth % of a forecast (one decimal) and its risk label."""
    ends = df.groupBy(*keys).agg(F.min_by(yhat, step).alias("first_value"), F.max_by(yhat, step).alias("last_value"))
    growth = F.round(change_rate(F.col("last_value"), F.col("first_value")) * 100, 1)
    risk = F.when(F.abs("growth_rate") > 20, "High").when(F.abs("growth_rate") > 10, "Medium").otherwise("Low")
    return ends.withColumn("growth_rate", growth).withColumn("risk_level", risk)
