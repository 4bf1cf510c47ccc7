"""Forecast accuracy, diagnostics and model comparison.

Input is a long frame of pairs ``(by…, ts, y, yhat)``, where ``by`` is usually
the keys and ``model``. All measures of one report are aggregates over frames
partitioned by ``by``, so a report costs one shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import by_time, correlation, known, match, per_series, ratio, sample_kurtosis, sample_skewness
from ..functions.student import t_quantile

BASIC = ("mae", "rmse", "mse", "r2", "mape", "smape", "me", "mpe")
# The metrics models are ranked by (all: lower is better).
RANKED = ("mae", "rmse", "mape")


def valid_pairs(pairs: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Pairs in which both are numbers: neither null nor NaN."""
    return pairs.where(known(y) & known(yhat))


def basic_aggregates(y: str = "y", yhat: str = "yhat") -> dict[str, Column]:
    """mae … mpe as aggregate columns. Points whose percentage is undefined are left out of the
    percentage means and counted in ``n_zero_actual``; with none left they read 100, 100 and 0."""
    a, p = F.col(y), F.col(yhat)
    e = a - p
    mse = F.avg(e * e)
    return {
        "n": F.count(e),
        "mae": F.avg(F.abs(e)),
        "rmse": F.sqrt(mse),
        "mse": mse,
        "r2": 1 - ratio(F.sum(e * e), F.var_pop(a) * F.count(e)),
        "mape": F.coalesce(F.avg(F.abs(ratio(e, a))) * 100, F.lit(100.0)),
        "smape": F.coalesce(F.avg(ratio(2 * F.abs(e), F.abs(a) + F.abs(p))) * 100, F.lit(100.0)),
        "me": F.avg(-e),
        "mpe": F.coalesce(F.avg(ratio(-e, a)) * 100, F.lit(0.0)),
        "n_zero_actual": F.count_if(a == 0),
    }


def _named(aggs: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in aggs.items()]


def forecast_metrics(pairs: DataFrame, by: Sequence[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    return valid_pairs(pairs, y, yhat).groupBy(*by).agg(*_named(basic_aggregates(y, yhat)))


def fit_statistics(rows: DataFrame, by: Sequence[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """(by, n, mean_residual, std_residual, mae, rmse, mape, r2) of in-sample rows: actual values beside fitted ones.

    std_residual is the population standard deviation; residuals are actual
    less fitted. Rows without a number on either side take no part.
    """
    e = F.col(y) - F.col(yhat)
    basic = basic_aggregates(y, yhat)
    found = {"n": basic["n"], "mean_residual": F.avg(e), "std_residual": F.stddev_pop(e), **{m: basic[m] for m in ("mae", "rmse", "mape", "r2")}}
    return valid_pairs(rows, y, yhat).groupBy(*by).agg(*_named(found))


def _changes(pairs: DataFrame, by: Sequence[str], ts: str, y: str, yhat: str) -> DataFrame:
    w = by_time(by, ts)
    return pairs.withColumns(
        {"_dy": F.col(y) - F.lag(y).over(w), "_dp": F.col(yhat) - F.lag(yhat).over(w)}
    )


# Fixed value: changes spread less than this share of the level are rounding noise on a constant change.
NOISE = 1e-6


def _directional_aggregates(y: str, yhat: str) -> dict[str, Column]:
    same = F.signum("_dy") == F.signum("_dp")

    def varies(change: str, level: str) -> Column:
        return F.stddev_pop(change) > NOISE * F.avg(F.abs(F.col(level)))

    both = varies("_dy", y) & varies("_dp", yhat)
    follows = F.greatest(F.lit(0.0), F.coalesce(correlation("_dy", "_dp"), F.lit(0.0))) * 100
    return {
        "directional_accuracy": F.coalesce(F.avg(same.cast("double")) * 100, F.lit(0.0)),
        "trend_accuracy": F.when(both, follows).otherwise(0.0),
    }


def directional_accuracy(
    pairs: DataFrame, by: Sequence[str], ts: str = "ts", y: str = "y", yhat: str = "yhat"
) -> DataFrame:
    """% of successive changes with the same sign, and the positive part of their correlation in %.

    Changes that do not vary (a straight-line forecast) have no correlation and give 0.
    """
    return _changes(pairs, by, ts, y, yhat).groupBy(*by).agg(*_named(_directional_aggregates(y, yhat)))


def seasonal_metrics(
    pairs: DataFrame, by: Sequence[str], ts: str = "ts", y: str = "y", yhat: str = "yhat", period: int = 12
) -> DataFrame:
    """The basic metrics of each position in the cycle (season 1..period by row order)."""
    placed = pairs.withColumn("season", (F.row_number().over(by_time(by, ts)) - 1) % period + 1)
    return forecast_metrics(placed, [*by, "season"], y, yhat)


def seasonal_summary(seasons: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and population std of the metrics across seasons."""
    aggs = []
    for m in ("mae", "rmse", "mape", "r2"):
        aggs += [F.avg(m).alias(f"avg_seasonal_{m}"), F.stddev_pop(m).alias(f"std_seasonal_{m}")]
    return seasons.groupBy(*by).agg(*aggs)


def _bias_aggregates(y: str, yhat: str) -> dict[str, Column]:
    bias = F.avg(F.col(yhat) - F.col(y))
    return {
        "bias": bias,
        "bias_percentage": F.coalesce(ratio(bias * 100, F.avg(y)), F.lit(0.0)),
        "forecast_tendency": F.when(bias > 0, "overforecasting").when(bias < 0, "underforecasting").otherwise("neutral"),
    }


def forecast_bias(pairs: DataFrame, by: Sequence[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    return valid_pairs(pairs, y, yhat).groupBy(*by).agg(*_named(_bias_aggregates(y, yhat)))


@F.pandas_udf(T.DoubleType())
def _t_critical(level: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([t_quantile(0.5 + lv / 2, int(k) - 1) if k > 1 else None for lv, k in zip(level, n)], dtype=float)


def residual_intervals(
    pairs: DataFrame,
    by: Sequence[str],
    y: str = "y",
    yhat: str = "yhat",
    level: float = 0.95,
    quantile: str = "t",
) -> DataFrame:
    """Each pair with yhat -/+ q * population std of the residuals.

    q is Student's t with n-1 degrees of freedom, or 1.96 for ``quantile="z"``;
    without enough residuals the band is 10 % of the prediction. The t
    quantile is evaluated once per group, not per row.
    """
    e = F.col(y) - F.col(yhat)
    whole = per_series(by)
    if quantile == "z":
        held = pairs.withColumn("_margin", F.stddev_pop(e).over(whole) * 1.96)
    else:
        facts = valid_pairs(pairs, y, yhat).groupBy(*by).agg(F.count("*").alias("_n"), F.stddev_pop(e).alias("_s"))
        scaled = facts.select(*by, (_t_critical(F.lit(level), F.col("_n")) * F.col("_s")).alias("_margin"))
        held = match(pairs, scaled, by, "left")
    margin = F.coalesce("_margin", F.abs(yhat) * 0.1)
    return held.withColumns(
        {"lower": F.col(yhat) - margin, "upper": F.col(yhat) + margin, "margin": margin}
    ).drop("_margin")


def _residual_aggregates() -> dict[str, Column]:
    return {
        "mean_residual": F.avg("_e"),
        "std_residual": F.stddev_pop("_e"),
        "residual_autocorr": F.coalesce(correlation("_e", "_e1"), F.lit(0.0)),
    }


def _residuals(pairs: DataFrame, by: Sequence[str], ts: str, y: str, yhat: str) -> DataFrame:
    e = F.col(y) - F.col(yhat)
    return pairs.withColumn("_e", e).withColumn("_e1", F.lag("_e").over(by_time(by, ts)))


def residual_analysis(
    pairs: DataFrame, by: Sequence[str], ts: str = "ts", y: str = "y", yhat: str = "yhat"
) -> DataFrame:
    """Mean, population std and lag-1 autocorrelation of y - yhat."""
    return _residuals(pairs, by, ts, y, yhat).groupBy(*by).agg(*_named(_residual_aggregates()))


def ljung_box(
    df: DataFrame, by: Sequence[str], ts: str = "ts", resid: str = "resid", lags: int = 10
) -> DataFrame:
    """Ljung-Box statistic, p-value and white-noise flag (p > 0.05), with the residuals' shape.

    The number of lags must be even: the chi-square tail then has a closed form.
    """
    if lags % 2:
        raise ValueError("an even number of lags is needed")
    w = by_time(by, ts)
    centred = df.withColumn("_d", F.col(resid) - F.avg(resid).over(per_series(by)))
    prods = centred.withColumns({f"_p{k}": F.col("_d") * F.lag("_d", k).over(w) for k in range(1, lags + 1)})
    n = F.count(resid).cast("double")
    total = F.sum(F.col("_d") * F.col("_d"))
    weighted = F.lit(0.0)
    for k in range(1, lags + 1):
        rho = ratio(F.sum(f"_p{k}"), total)
        weighted = weighted + ratio(rho * rho, n - k)
    facts = prods.groupBy(*by).agg(
        F.count(resid).alias("n"),
        (n * (n + 2) * weighted).alias("lb_stat"),
        F.avg(resid).alias("mean_residual"),
        F.stddev_samp(resid).alias("std_residual"),
        F.min(resid).alias("min_residual"),
        F.max(resid).alias("max_residual"),
        sample_skewness(resid).alias("skewness"),
        sample_kurtosis(resid).alias("kurtosis"),
    )
    half = F.col("lb_stat") / 2
    tail = sum((F.pow(half, F.lit(j)) / math.factorial(j) for j in range(lags // 2)), F.lit(0.0))
    return facts.withColumn("lb_pvalue", F.exp(-half) * tail).withColumn(
        "is_white_noise", F.col("lb_pvalue") > 0.05
    )


def evaluation_report(
    pairs: DataFrame, by: Sequence[str], ts: str = "ts", y: str = "y", yhat: str = "yhat"
) -> DataFrame:
    """Basic, directional, bias and residual measures with a grade, strengths and weaknesses, one row per group.

    Windows and the aggregate share the partitioning by ``by``: one shuffle.
    """
    good = valid_pairs(pairs, y, yhat)
    ready = _residuals(_changes(good, by, ts, y, yhat), by, ts, y, yhat)
    facts = ready.groupBy(*by).agg(
        *_named(basic_aggregates(y, yhat)),
        *_named(_directional_aggregates(y, yhat)),
        *_named(_bias_aggregates(y, yhat)),
        *_named(_residual_aggregates()),
    )
    mape, r2, hits = F.col("mape"), F.col("r2"), F.col("directional_accuracy")
    # Grade limits and the notes given with them.
    grade = (
        F.when((mape < 10) & (r2 > 0.8), "Excellent")
        .when((mape < 20) & (r2 > 0.6), "Good")
        .when((mape < 30) & (r2 > 0.4), "Fair")
        .otherwise("Poor")
    )
    strengths = [(r2 > 0.8, "High explanatory power"), (mape < 15, "Low prediction error"), (hits > 70, "Good directional accuracy")]
    weaknesses = [(r2 < 0.5, "Low explanatory power"), (mape > 25, "High prediction error")]

    def notes(items) -> Column:
        return F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in items]), lambda x: x.isNotNull())

    return facts.withColumns(
        {"performance_level": grade, "key_strengths": notes(strengths), "areas_for_improvement": notes(weaknesses)}
    )


# ---- comparing models ---------------------------------------------------------------

def long_metrics(wide: DataFrame, by: Sequence[str], metrics: Sequence[str] = BASIC) -> DataFrame:
    """(by…, metric, value)."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return wide.select(*by, F.explode(cells).alias("_m")).select(*by, "_m.*")


def model_ranking(
    metrics: DataFrame, keys: Sequence[str] = (), ranked: Sequence[str] = RANKED
) -> DataFrame:
    """(keys, metric, model, value, rank): ascending per metric, ties by model name."""
    table = long_metrics(metrics, [*keys, "model"], ranked).where(F.col("value").isNotNull())
    order = Window.partitionBy(*keys, "metric").orderBy("value", "model")
    return table.withColumn("rank", F.row_number().over(order))


def model_best(metrics: DataFrame, keys: Sequence[str] = (), ranked: Sequence[str] = RANKED) -> DataFrame:
    """The model with the lowest mean rank per key, ties by name."""
    ranks = model_ranking(metrics, keys, ranked).groupBy(*keys, "model").agg(F.avg("rank").alias("average_rank"))
    return ranks.groupBy(*keys).agg(
        F.min_by("model", F.struct("average_rank", "model")).alias("best_model"),
        F.min("average_rank").alias("average_rank"),
        F.count("*").alias("total_models"),
    )


def metrics_pivot(
    metrics: DataFrame, models: Sequence[str], keys: Sequence[str] = (), shown: Sequence[str] = ("mae", "rmse", "mape", "r2")
) -> DataFrame:
    """Metric rows by model columns. Naming the models spares the job that would look them up."""
    table = long_metrics(metrics, [*keys, "model"], shown)
    return table.groupBy(*keys, "metric").pivot("model", list(models)).agg(F.first("value"))
