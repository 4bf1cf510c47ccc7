"""Fitted model queries: ARIMA, additive, lag regression, look-back, and the job over all members."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import additive, arima, crossval, lagreg, lookback
from . import forecasting, panels
from .panels import NATION_M, PRIORITY_M
from .registry import query

NATION = ["nation"]
_FORECAST = "nation:i step:i ds:d yhat:2 lower:2 upper:2"


@query("arima_forecast", _FORECAST + " status:s")
def _arima(spark, sf):
    return arima.arima_forecast(panels.nation_monthly(spark, sf), NATION)


@query(
    "arima_seasonal_naive",
    _FORECAST + " status:s",
    f"""WITH {NATION_M},
o AS (SELECT nation, ts, y, row_number() OVER w AS i, count(*) OVER (PARTITION BY nation) AS n,
  y - lag(y) OVER w - lag(y, 12) OVER w + lag(y, 13) OVER w AS z FROM nm WINDOW w AS (PARTITION BY nation ORDER BY ts)),
s AS (SELECT nation, sqrt(avg(z * z)) AS sigma, max(n) AS n, max(ts) AS hi FROM o GROUP BY 1),
e AS (SELECT s.*, o.y AS last_y, b.y AS year_before FROM s JOIN o ON o.nation = s.nation AND o.i = s.n JOIN o AS b ON b.nation = s.nation AND b.i = s.n - 12),
p AS (SELECT e.nation, step, last_day(CAST(hi AS DATE) - INTERVAL 27 DAY + INTERVAL 1 MONTH * step) AS ds, o.y + last_y - year_before AS yhat,
  1.959963984540054 * sigma * sqrt(step) AS half
  FROM e, unnest(range(1, 13)) AS t(step) JOIN o ON o.nation = e.nation AND o.i = e.n - 12 + step)
SELECT nation, step, ds, yhat, yhat - half AS lower, yhat + half AS upper, 'success' AS status FROM p""",
)
def _arima_naive(spark, sf):
    """The model without weights, whose forecast and interval are plain arithmetic."""
    return arima.arima_forecast(panels.nation_monthly(spark, sf), NATION, order=(0, 1, 0), seasonal=(0, 1, 0))


@query("arima_exog_forecast", _FORECAST + " status:s")
def _arima_exog(spark, sf):
    """Days per month and a year-end flag as regressors, known ahead from the calendar."""
    from ..operators.resample import future_calendar

    panel = panels.nation_monthly(spark, sf)
    made = lambda df, c: df.withColumns({"days": F.day(c).cast("double"), "year_end": (F.month(c) == 12).cast("double")})
    ahead = made(future_calendar(panel, 12, NATION), "ds")
    return arima.arima_forecast(made(panel, "ts"), NATION, exog=("days", "year_end"), future_exog=ahead)


@query("arima_search", "priority:s p:i d:i q:i sp:i sd:i sq:i n_eff:i aic:4 bic:4 hqic:4 status:s")
def _search(spark, sf):
    """All 864 candidate orders of each series."""
    return arima.order_search(panels.priority_monthly(spark, sf), ["priority"])


@query("arima_best_order", "priority:s p:i d:i q:i sp:i sd:i sq:i aic:4")
def _best(spark, sf):
    return arima.best_orders(arima.order_search(panels.priority_monthly(spark, sf), ["priority"]), ["priority"])


@query("additive_forecast", _FORECAST)
def _additive(spark, sf):
    return additive.additive_forecast(panels.nation_monthly(spark, sf), NATION)


@query("additive_components", "nation:i ts:d step:i y:2 yhat:2 trend:2 yearly:2 monthly:2 quarterly:2")
def _components(spark, sf):
    return additive.additive_fit(panels.nation_monthly(spark, sf), NATION)


@query("additive_importance", "nation:i component:s variance:2 importance:6")
def _importance(spark, sf):
    return additive.additive_importance(panels.nation_monthly(spark, sf), NATION)


@query("changepoints", "nation:i changepoint:d position:6 delta:2 significant:b")
def _changepoints(spark, sf):
    return additive.changepoints(panels.nation_monthly(spark, sf), NATION)


@query("lag_regression_fit", "nation:i n_rows:i n_features:i n_nonzero:i r2:6 mae:4 rmse:4")
def _lag_fit(spark, sf):
    fitted = lagreg.lag_regression_fit(panels.nation_monthly(spark, sf), NATION, model=lagreg.LagRegression("ridge"))
    return fitted.withColumn("n_features", F.size("features"))


@query("lag_regression_importance", "nation:i feature:s coef:4 importance:4 rank:i")
def _lag_importance(spark, sf):
    fitted = lagreg.lag_regression_fit(panels.nation_monthly(spark, sf), NATION, model=lagreg.LagRegression("lasso"))
    return lagreg.coefficient_importance(fitted, NATION, 10)


@query(
    "lag_regression_single",
    "nation:i n_rows:i slope:6 intercept:2 r2:6 mae:2 rmse:2",
    f"""WITH {NATION_M},
f AS (SELECT nation, ts, y, lag(y) OVER w AS x, row_number() OVER w AS rn FROM nm WINDOW w AS (PARTITION BY nation ORDER BY ts)),
g AS (SELECT * FROM f WHERE rn > 12),
c AS (SELECT nation, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, count(*) AS n_rows FROM g GROUP BY 1)
SELECT nation, any_value(n_rows) AS n_rows, any_value(slope) AS slope, any_value(intercept) AS intercept, any_value(r2) AS r2,
  avg(abs(y - intercept - slope * x)) AS mae, sqrt(avg((y - intercept - slope * x) ** 2)) AS rmse FROM g JOIN c USING (nation) GROUP BY 1""",
)
def _lag_single(spark, sf):
    """The per-series solver with one candidate feature, where the answer is a plain regression."""
    fitted = lagreg.lag_regression_fit(panels.nation_monthly(spark, sf), NATION, features=["y_lag_1"])
    slope = F.col("coef")[0] / F.col("width")[0]
    return fitted.withColumns({"slope": slope, "intercept": F.col("intercept") - slope * F.col("center")[0]})


@query(
    "lag_regression_forecast_single",
    _FORECAST,
    f"""WITH {NATION_M},
f AS (SELECT nation, ts, y, lag(y) OVER w AS x, row_number() OVER w AS rn FROM nm WINDOW w AS (PARTITION BY nation ORDER BY ts)),
c AS (SELECT nation, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM f WHERE rn > 12 GROUP BY 1),
r AS (SELECT nation, any_value(a) AS a, any_value(b) AS b, 1.96 * stddev_pop(y - a - b * x) AS half FROM f JOIN c USING (nation) WHERE rn > 12 GROUP BY 1),
e AS (SELECT nation, max(ts) AS hi, arg_max(y, ts) AS last_y FROM nm GROUP BY 1),
p AS (SELECT nation, step, last_day(CAST(hi AS DATE) - INTERVAL 27 DAY + INTERVAL 1 MONTH * step) AS ds, a * (1 - b ** step) / (1 - b) + b ** step * last_y AS yhat, half
  FROM r JOIN e USING (nation), unnest(range(1, 13)) AS t(step))
SELECT nation, step, ds, yhat, yhat - half AS lower, yhat + half AS upper FROM p""",
)
def _lag_forecast_single(spark, sf):
    """The recursion with the last value as its one feature, where it is a geometric sum."""
    panel = panels.nation_monthly(spark, sf)
    fitted = lagreg.lag_regression_fit(panel, NATION, features=["y_lag_1"])
    return lagreg.lag_regression_forecast(panel, NATION, models=fitted)


@query("lag_regression_forecast", _FORECAST)
def _lag_forecast(spark, sf):
    return lagreg.lag_regression_forecast(panels.nation_monthly(spark, sf), NATION, model=lagreg.LagRegression("ridge"))


@query("lag_regression_pooled", "feature:s coef:6")
def _lag_pooled(spark, sf):
    """One Spark ML regression over every part's series."""
    features = ["y_lag_1", "y_lag_2", "y_lag_3", "y_lag_12", "rolling_mean_3", "rolling_mean_12", "month_sin", "month_cos", "linear_trend"]
    model, names = lagreg.pooled_lag_regression(panels.part_monthly(spark, sf), ["part"], kind="ridge", features=features)
    rows = [(n, float(c)) for n, c in zip(names, model.coefficients)] + [("(intercept)", float(model.intercept))]
    return spark.createDataFrame(rows, "feature string, coef double")


@query("lookback_forecast", _FORECAST)
def _lookback(spark, sf):
    return lookback.lookback_forecast(panels.nation_monthly(spark, sf), NATION)


def members():
    """The members of the ensemble as (panel, keys, horizon) functions."""
    return {
        "additive": lambda df, keys, h: additive.additive_forecast(df, keys, h),
        "arima": lambda df, keys, h: arima.arima_forecast(df, keys, h),
        "lag_regression": lambda df, keys, h: lagreg.lag_regression_forecast(df, keys, h, model=lagreg.LagRegression("ridge")),
    }


@query("holdout_scores", "priority:s model:s mae:2 rmse:2 mape:4 status:s")
def _scores(spark, sf):
    return forecasting.holdout_scores(panels.priority_monthly(spark, sf), members(), ["priority"])


def _repeat_last(df, keys, horizon):
    last = df.groupBy(*keys).agg(F.max_by("y", "ts").alias("yhat"), F.max("ts").alias("hi"))
    steps = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    none = F.lit(None).cast("double")
    return steps.select(*keys, "step", F.last_day(F.add_months("hi", F.col("step"))).alias("ds"), "yhat", none.alias("lower"), none.alias("upper"))


def _too_short(df, keys, horizon):
    return _repeat_last(df, keys, horizon).withColumn("status", F.lit("short"))


@query(
    "ensemble_status",
    "priority:s model:s mae:2 rmse:2 mape:4 status:s weight:6",
    f"""WITH {PRIORITY_M},
h AS (SELECT priority, ts, y, row_number() OVER (PARTITION BY priority ORDER BY ts) - 1 AS i, CAST(floor(count(*) OVER (PARTITION BY priority) * 0.8) AS BIGINT) AS cut FROM pm),
b AS (SELECT priority, y AS base FROM h WHERE i = cut - 1),
m AS (SELECT priority, avg(abs(y - base)) AS mae, sqrt(avg((y - base) ** 2)) AS rmse, avg(abs(y - base) / abs(nullif(y, 0))) * 100 AS mape
  FROM h JOIN b USING (priority) WHERE i >= cut GROUP BY 1)
SELECT priority, 'last' AS model, mae, rmse, mape, 'success' AS status, 1.0 AS weight FROM m
UNION ALL SELECT priority, 'short', NULL, NULL, NULL, 'failed', 0.0 FROM m""",
)
def _status(spark, sf):
    """Members' hold-out scores over every test row, their own status and their weights."""
    return forecasting.fit(panels.priority_monthly(spark, sf), {"last": _repeat_last, "short": _too_short}, ["priority"]).contributions()


@query("cv_models", "priority:s model:s n_folds:i avg_mae:2 std_mae:2 avg_rmse:2 std_rmse:2 avg_mape:4 std_mape:4")
def _cv_models(spark, sf):
    """ARIMA and the additive model refitted on every fold of every series."""
    chosen = {name: m for name, m in members().items() if name != "lag_regression"}
    pairs = forecasting.cross_validate(panels.priority_monthly(spark, sf), chosen, ["priority"])
    return crossval.cv_scores(pairs, ["priority", "model"])


@query("cv_cutoff_scores", "priority:s model:s n_folds:i avg_mae:2 std_mae:2 avg_rmse:2 std_rmse:2 avg_mape:4 std_mape:4")
def _cv_cutoff_scores(spark, sf):
    pairs = forecasting.cross_validate_cutoffs(
        panels.priority_monthly(spark, sf), {"additive": members()["additive"]}, ["priority"]
    )
    return crossval.cv_scores(pairs, ["priority", "model"])


@query("ensemble_forecast", "priority:s step:i ds:d n_models:i yhat:2 lower:2 upper:2")
def _ensemble(spark, sf):
    """Fit three members, score them on a hold-out, weigh and combine their forecasts."""
    fitted = forecasting.fit(panels.priority_monthly(spark, sf), members(), ["priority"], 12)
    return fitted.combined()


@query("compare_models", "priority:s best_model:s average_rank:4 total_models:i")
def _compare(spark, sf):
    from ..operators.metrics import model_best

    scores = forecasting.holdout_scores(panels.priority_monthly(spark, sf), members(), ["priority"])
    return model_best(scores.where("status = 'success'"), ["priority"])
