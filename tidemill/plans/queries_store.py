"""Models as tables: fitted once, saved, used later and fitted on; what a fit reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import additive, arima, lagreg, metrics
from ..session import scratch_dir
from . import model_store, panels
from .panels import NATION_M
from .registry import query

NATION = ["nation"]
_FORECAST = "nation:i model:s step:i ds:d yhat:2"
PATHS = ("trend", "recent_slope", "seasonal_path")
# Rows up to this day are fitted first; the later ones arrive afterwards.
FIRST_DAY = "1997-03-31"

_PATHS_SQL = """
i AS (SELECT nation, ts, y, row_number() OVER (PARTITION BY nation ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY nation) AS n FROM nm),
f AS (SELECT nation, max(n) AS n, max(ts) AS hi, arg_max(y, ts) AS last_y, regr_slope(y, i) AS slope, regr_intercept(y, i) AS icept,
  regr_slope(CASE WHEN i >= n - 12 THEN y END, i) AS near FROM i GROUP BY 1)"""


def _paths(spark, sf):
    return {name: model_store.path_family(name) for name in PATHS}


@query(
    "model_info",
    "nation:i model:s version:i n_rows:i last_ts:d n_parameters:i status:s",
    f"""WITH {NATION_M}, s AS (SELECT nation, count(*) AS n, max(ts) AS hi FROM nm GROUP BY 1),
m(model, lost, k) AS (VALUES ('trend', 0, 2), ('recent_slope', 0, 2), ('seasonal_path', 0, 2), ('arima', 13, 5), ('lag_regression', 12, 16), ('additive', 0, 42))
SELECT nation, model, 1 AS version, n - lost AS n_rows, hi AS last_ts, k AS n_parameters, 'success' AS status FROM s, m""",
)
def _info(spark, sf):
    """Every family fitted to every nation's series, saved, and read back."""
    path = f"{scratch_dir(spark, 'models')}/panel"
    model_store.train(panels.nation_monthly(spark, sf), keys=NATION).save(path)
    return model_store.TrainedPanel.load(spark, path).info()


@query(
    "forecast_from_saved",
    _FORECAST,
    f"""WITH {NATION_M}, {_PATHS_SQL},
p AS (SELECT f.*, step, last_day(CAST(hi AS DATE) - INTERVAL 27 DAY + INTERVAL 1 MONTH * step) AS ds FROM f, unnest(range(1, 8)) AS t(step))
SELECT nation, 'trend' AS model, step, ds, icept + slope * (n - 1 + step) AS yhat FROM p
UNION ALL SELECT nation, 'recent_slope', step, ds, last_y + step * near FROM p""",
)
def _saved(spark, sf):
    """A horizon that was not known when the models were fitted, from the saved tables alone."""
    path = f"{scratch_dir(spark, 'models')}/panel"
    chosen = {name: model_store.path_family(name) for name in PATHS[:2]}
    model_store.train(panels.nation_monthly(spark, sf), chosen, NATION).save(path)
    return model_store.TrainedPanel.load(spark, path).forecast(7)


@query(
    "retrained_forecast",
    "nation:i model:s version:i step:i ds:d yhat:2",
    f"""WITH {NATION_M}, {_PATHS_SQL},
p AS (SELECT f.*, step, last_day(CAST(hi AS DATE) - INTERVAL 27 DAY + INTERVAL 1 MONTH * step) AS ds FROM f, unnest(range(1, 13)) AS t(step))
SELECT nation, 'trend' AS model, 2 AS version, step, ds, icept + slope * (n - 1 + step) AS yhat FROM p
UNION ALL SELECT nation, 'recent_slope', 2, step, ds, last_y + step * near FROM p""",
)
def _retrained(spark, sf):
    """Models of the first years, fitted on by the later rows alone, equal to a fit on all rows."""
    panel = panels.nation_monthly(spark, sf)
    chosen = {name: model_store.path_family(name) for name in PATHS[:2]}
    trained = model_store.train(panel.where(F.col("ts") <= FIRST_DAY), chosen, NATION).retrain(panel.where(F.col("ts") > FIRST_DAY))
    return trained.forecast(12).withColumn("version", F.lit(trained.version))


@query(
    "lag_regression_ridge",
    "nation:i n_rows:i b_lag_1:6 b_lag_12:6 intercept:1 r2:6 mae:1 rmse:1",
    f"""WITH {NATION_M},
f AS (SELECT nation, y, lag(y) OVER w AS x1, lag(y, 12) OVER w AS x2, row_number() OVER w AS rn FROM nm WINDOW w AS (PARTITION BY nation ORDER BY ts)),
g AS (SELECT * FROM f WHERE rn > 12),
m AS (SELECT nation, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, var_pop(y) AS vy,
  corr(x1, x2) AS r, covar_pop(x1, y) / stddev_pop(x1) AS c1, covar_pop(x2, y) / stddev_pop(x2) AS c2 FROM g GROUP BY 1),
b AS (SELECT *, n * ((n + 10) * c1 - n * r * c2) / ((n + 10) ** 2 - (n * r) ** 2) / s1 AS b1, n * ((n + 10) * c2 - n * r * c1) / ((n + 10) ** 2 - (n * r) ** 2) / s2 AS b2 FROM m),
e AS (SELECT b.*, y - my - b1 * (x1 - m1) - b2 * (x2 - m2) AS e FROM g JOIN b USING (nation))
SELECT nation, any_value(n) AS n_rows, any_value(b1) AS b_lag_1, any_value(b2) AS b_lag_12, any_value(my - b1 * m1 - b2 * m2) AS intercept,
  1 - avg(e * e) / any_value(vy) AS r2, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse FROM e GROUP BY 1""",
)
def _ridge(spark, sf):
    """Ridge on two features, where the solution is written out."""
    fitted = lagreg.lag_regression_fit(panels.nation_monthly(spark, sf), NATION, model=lagreg.LagRegression("ridge", 10.0), features=["y_lag_1", "y_lag_12"])
    slope = lambda i: F.col("coef")[i] / F.col("width")[i]
    level = F.col("intercept") - slope(0) * F.col("center")[0] - slope(1) * F.col("center")[1]
    return fitted.withColumns({"b_lag_1": slope(0), "b_lag_12": slope(1), "intercept": level})


_AR1_SQL = f"""WITH {NATION_M},
d AS (SELECT nation, ts, y, y - lag(y) OVER w AS z, y - lag(y) OVER w AS now FROM nm WINDOW w AS (PARTITION BY nation ORDER BY ts)),
l AS (SELECT *, lag(z) OVER (PARTITION BY nation ORDER BY ts) AS before FROM d WHERE z IS NOT NULL),
c AS (SELECT nation, greatest(least(sum(z * before) / sum(before * before), 0.98), -0.98) AS phi FROM l WHERE before IS NOT NULL GROUP BY 1),
e AS (SELECT l.nation, ts, y, z - phi * coalesce(before, 0) AS resid FROM l JOIN c USING (nation))
"""


@query("arima_residuals", "nation:i ts:d y:2 yhat:0 resid:0", _AR1_SQL + "SELECT nation, ts, y, y - resid AS yhat, resid FROM e")
def _residuals(spark, sf):
    """One-step errors of an autoregression of the differences, whose coefficient is one ratio of sums."""
    return arima.arima_residuals(panels.nation_monthly(spark, sf), NATION, order=(1, 1, 0), seasonal=(0, 0, 0))


@query(
    "fit_statistics",
    "nation:i n:i mean_residual:0 std_residual:0 mae:0 rmse:0 mape:3 r2:5",
    _AR1_SQL
    + """SELECT nation, count(*) AS n, avg(resid) AS mean_residual, stddev_pop(resid) AS std_residual, avg(abs(resid)) AS mae, sqrt(avg(resid * resid)) AS rmse,
  avg(abs(resid / nullif(y, 0))) * 100 AS mape, 1 - sum(resid * resid) / (var_pop(y) * count(*)) AS r2 FROM e GROUP BY 1""",
)
def _statistics(spark, sf):
    rows = arima.arima_residuals(panels.nation_monthly(spark, sf), NATION, order=(1, 1, 0), seasonal=(0, 0, 0))
    return metrics.fit_statistics(rows, NATION)


@query("additive_fit_statistics", "nation:i n:i mean_residual:2 std_residual:2 mae:2 rmse:2 mape:4 r2:6")
def _additive_statistics(spark, sf):
    return metrics.fit_statistics(additive.additive_fit(panels.nation_monthly(spark, sf), NATION, 0), NATION)


@query("arima_ljung_box", "nation:i n:i lb_stat:2 lb_pvalue:3 is_white_noise:b")
def _white_noise(spark, sf):
    """Whether the default model leaves autocorrelation in its errors."""
    rows = arima.arima_residuals(panels.nation_monthly(spark, sf), NATION)
    return metrics.ljung_box(rows, NATION)


@query("changepoints_sparse", "nation:i changepoint:d position:6 delta:0 selected:b")
def _sparse(spark, sf):
    """Slope changes by an L1 path: exactly 0 where a series does not bend."""
    return additive.sparse_changepoints(panels.nation_monthly(spark, sf), NATION)
