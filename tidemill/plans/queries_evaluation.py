"""Metrics, comparison, cross-validation and ensemble queries over closed-form forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar_effects, crossval, ensemble, metrics
from . import forecasting, panels
from .panels import NATION_ALL, NATION_M, PART_M
from .registry import query, table

BY = ["nation", "model"]

_PAIRS = f"""{NATION_M},
ho AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY nation) AS n,
  CAST(floor(count(*) OVER (PARTITION BY nation) * 0.8) AS BIGINT) AS split FROM nm),
hf AS (SELECT nation, regr_slope(y, idx) AS slope, regr_intercept(y, idx) AS intercept, regr_slope(y, idx) FILTER (idx >= split - 12) AS slope12,
  arg_max(y, idx) AS last_value, month(max(ts)) AS last_month FROM ho WHERE idx < split GROUP BY 1),
ht AS (SELECT ho.nation, ts, y, idx, idx - split + 1 AS step, slope, intercept, slope12, last_value, last_month FROM ho JOIN hf USING (nation) WHERE idx >= split),
pairs_any AS (SELECT nation, 'recent_slope' AS model, step, ts, y, last_value + step * slope12 AS yhat FROM ht
  UNION ALL SELECT nation, 'seasonal_path', step, ts, y, last_value + step * slope12 * (1 + 0.1 * sin(2 * pi() * (step - 1 + last_month) / 12)) FROM ht
  UNION ALL SELECT nation, 'trend', step, ts, y, intercept + slope * idx FROM ht),
pairs AS MATERIALIZED (SELECT nation, model, step, ts, y, round(yhat, 2) AS yhat FROM pairs_any)"""


def _pairs(spark, sf):
    pairs = forecasting.holdout_paths(panels.nation_monthly(spark, sf), ["nation"])
    return pairs.withColumn("yhat", F.round("yhat", 2))


def _basic_sql(by: str, source: str, where: str = "") -> str:
    return f"""SELECT {by}, count(*) AS n, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) ** 2)) AS rmse, avg((y - yhat) ** 2) AS mse,
  1 - sum((y - yhat) ** 2) / nullif(var_pop(y) * count(*), 0) AS r2, coalesce(avg(abs((y - yhat) / nullif(y, 0))) * 100, 100) AS mape,
  coalesce(avg(2 * abs(y - yhat) / nullif(abs(y) + abs(yhat), 0)) * 100, 100) AS smape, avg(yhat - y) AS me,
  coalesce(avg((yhat - y) / nullif(y, 0)) * 100, 0) AS mpe, count(*) FILTER (y = 0) AS n_zero_actual
FROM {source} {where} GROUP BY {by}"""


_BASIC_SPEC = "n:i mae:6 rmse:4 mse:0 r2:6 mape:6 smape:6 me:6 mpe:6 n_zero_actual:i"


@query("holdout_paths", "nation:i model:s step:i ts:d y:2 yhat:2", f"WITH {_PAIRS} SELECT * FROM pairs")
def _holdout_paths(spark, sf):
    return _pairs(spark, sf)


@query("forecast_metrics", f"nation:i model:s {_BASIC_SPEC}", f"WITH {_PAIRS} {_basic_sql('nation, model', 'pairs')}")
def _metrics(spark, sf):
    return metrics.forecast_metrics(_pairs(spark, sf), BY)


_DIRECTION = """dir AS (SELECT nation, model, coalesce(avg(CASE WHEN sign(dy) = sign(dp) THEN 1.0 WHEN dy IS NOT NULL THEN 0.0 END) * 100, 0) AS directional_accuracy,
  CASE WHEN stddev_pop(dy) > 1e-6 * avg(abs(y)) AND stddev_pop(dp) > 1e-6 * avg(abs(yhat)) THEN greatest(0, coalesce(corr(dy, dp), 0)) * 100 ELSE 0 END AS trend_accuracy
  FROM (SELECT nation, model, y, yhat, y - lag(y) OVER w AS dy, yhat - lag(yhat) OVER w AS dp FROM pairs WINDOW w AS (PARTITION BY nation, model ORDER BY ts)) GROUP BY 1, 2)"""


@query(
    "directional_accuracy",
    "nation:i model:s directional_accuracy:6 trend_accuracy:6",
    f"WITH {_PAIRS}, {_DIRECTION} SELECT * FROM dir",
)
def _direction(spark, sf):
    return metrics.directional_accuracy(_pairs(spark, sf), BY)


_SEASONS = f"""sp AS (SELECT *, (row_number() OVER (PARTITION BY nation, model ORDER BY ts) - 1) % 12 + 1 AS season FROM pairs),
sm AS ({_basic_sql('nation, model, season', 'sp')})"""


@query("seasonal_metrics", f"nation:i model:s season:i {_BASIC_SPEC}", f"WITH {_PAIRS}, {_SEASONS} SELECT * FROM sm")
def _seasonal(spark, sf):
    return metrics.seasonal_metrics(_pairs(spark, sf), BY)


@query(
    "seasonal_metrics_summary",
    "nation:i model:s avg_seasonal_mae:0 std_seasonal_mae:2 avg_seasonal_rmse:2 std_seasonal_rmse:2 avg_seasonal_mape:6 std_seasonal_mape:6",
    f"""WITH {_PAIRS}, {_SEASONS} SELECT nation, model, avg(mae) AS avg_seasonal_mae, stddev_pop(mae) AS std_seasonal_mae,
  avg(rmse) AS avg_seasonal_rmse, stddev_pop(rmse) AS std_seasonal_rmse, avg(mape) AS avg_seasonal_mape, stddev_pop(mape) AS std_seasonal_mape FROM sm GROUP BY 1, 2""",
)
def _seasonal_summary(spark, sf):
    return metrics.seasonal_summary(metrics.seasonal_metrics(_pairs(spark, sf), BY), BY)


_BIAS = """bias AS (SELECT nation, model, avg(yhat - y) AS bias, coalesce(avg(yhat - y) * 100 / nullif(avg(y), 0), 0) AS bias_percentage,
  CASE WHEN avg(yhat - y) > 0 THEN 'overforecasting' WHEN avg(yhat - y) < 0 THEN 'underforecasting' ELSE 'neutral' END AS forecast_tendency FROM pairs GROUP BY 1, 2)"""


@query(
    "forecast_bias", "nation:i model:s bias:6 bias_percentage:6 forecast_tendency:s", f"WITH {_PAIRS}, {_BIAS} SELECT * FROM bias"
)
def _bias(spark, sf):
    return metrics.forecast_bias(_pairs(spark, sf), BY)


@query("residual_intervals", "nation:i model:s ts:d yhat:2 lower:2 upper:2 margin:2")
def _intervals(spark, sf):
    return metrics.residual_intervals(_pairs(spark, sf), BY)


@query(
    "residual_intervals_z",
    "nation:i model:s ts:d yhat:2 lower:2 upper:2 margin:2",
    f"""WITH {_PAIRS}, m AS (SELECT nation, model, stddev_pop(y - yhat) * 1.96 AS margin FROM pairs GROUP BY 1, 2)
SELECT *, yhat - margin AS lower, yhat + margin AS upper FROM pairs JOIN m USING (nation, model)""",
)
def _intervals_z(spark, sf):
    return metrics.residual_intervals(_pairs(spark, sf), BY, quantile="z")


_RESID = """res AS (SELECT nation, model, avg(e) AS mean_residual, stddev_pop(e) AS std_residual, coalesce(corr(e, e1), 0) AS residual_autocorr
  FROM (SELECT nation, model, y - yhat AS e, lag(y - yhat) OVER (PARTITION BY nation, model ORDER BY ts) AS e1 FROM pairs) GROUP BY 1, 2)"""


@query(
    "residual_analysis",
    "nation:i model:s mean_residual:6 std_residual:4 residual_autocorr:6",
    f"WITH {_PAIRS}, {_RESID} SELECT * FROM res",
)
def _residuals(spark, sf):
    return metrics.residual_analysis(_pairs(spark, sf), BY)


def _ljung_sql() -> str:
    lags = ", ".join(f"lag(d, {k}) OVER (PARTITION BY nation, model ORDER BY ts) AS l{k}" for k in range(1, 11))
    stat = " + ".join(f"(sum(d * l{k}) / sum(d * d)) ** 2 / (count(*) - {k})" for k in range(1, 11))
    tail = " + ".join(f"(lb_stat / 2) ** {j} / {f}" for j, f in enumerate((1, 1, 2, 6, 24)))
    return f"""WITH {_PAIRS},
e AS (SELECT nation, model, ts, y - yhat AS e, y - yhat - avg(y - yhat) OVER (PARTITION BY nation, model) AS d FROM pairs),
l AS (SELECT *, {lags} FROM e),
s AS (SELECT nation, model, count(*) AS n, count(*) * (count(*) + 2.0) * ({stat}) AS lb_stat, avg(e) AS mean_residual, stddev_samp(e) AS std_residual,
  min(e) AS min_residual, max(e) AS max_residual, skewness(e) AS skewness, kurtosis(e) AS kurtosis FROM l GROUP BY 1, 2),
p AS (SELECT *, exp(-lb_stat / 2) * ({tail}) AS lb_pvalue FROM s)
SELECT *, lb_pvalue > 0.05 AS is_white_noise FROM p"""


@query(
    "ljung_box",
    "nation:i model:s n:i lb_stat:6 lb_pvalue:6 is_white_noise:b mean_residual:6 std_residual:4 min_residual:2 max_residual:2 skewness:6 kurtosis:6",
    _ljung_sql(),
)
def _ljung(spark, sf):
    return metrics.ljung_box(_pairs(spark, sf).withColumn("resid", F.col("y") - F.col("yhat")), BY)


@query(
    "evaluation_report",
    "nation:i model:s n:i mae:6 rmse:4 r2:6 mape:6 directional_accuracy:6 trend_accuracy:6 bias:6 forecast_tendency:s std_residual:4 "
    "residual_autocorr:6 performance_level:s strengths:s weaknesses:s",
    f"""WITH {_PAIRS}, {_DIRECTION}, {_BIAS}, {_RESID}, bas AS ({_basic_sql('nation, model', 'pairs')})
SELECT *, CASE WHEN mape < 10 AND r2 > 0.8 THEN 'Excellent' WHEN mape < 20 AND r2 > 0.6 THEN 'Good' WHEN mape < 30 AND r2 > 0.4 THEN 'Fair' ELSE 'Poor' END AS performance_level,
  concat_ws('; ', CASE WHEN r2 > 0.8 THEN 'High explanatory power' END, CASE WHEN mape < 15 THEN 'Low prediction error' END,
    CASE WHEN directional_accuracy > 70 THEN 'Good directional accuracy' END) AS strengths,
  concat_ws('; ', CASE WHEN r2 < 0.5 THEN 'Low explanatory power' END, CASE WHEN mape > 25 THEN 'High prediction error' END) AS weaknesses
FROM bas JOIN dir USING (nation, model) JOIN bias USING (nation, model) JOIN res USING (nation, model)""",
)
def _report(spark, sf):
    report = metrics.evaluation_report(_pairs(spark, sf), BY)
    return report.withColumns(
        {"strengths": F.concat_ws("; ", "key_strengths"), "weaknesses": F.concat_ws("; ", "areas_for_improvement")}
    )


_SCORES = f"{_PAIRS}, bas AS MATERIALIZED ({_basic_sql('nation, model', 'pairs')})"
_LONG = " UNION ALL ".join(f"SELECT nation, '{m}' AS metric, model, {m} AS value FROM bas" for m in metrics.RANKED)
_RANKS = f"{_SCORES}, lng AS ({_LONG}), rnk AS (SELECT *, row_number() OVER (PARTITION BY nation, metric ORDER BY value, model) AS rank FROM lng)"


@query("model_ranking", "nation:i metric:s model:s value:6 rank:i", f"WITH {_RANKS} SELECT * FROM rnk")
def _ranking(spark, sf):
    return metrics.model_ranking(metrics.forecast_metrics(_pairs(spark, sf), BY), ["nation"])


@query(
    "model_best",
    "nation:i best_model:s average_rank:6 total_models:i",
    f"""WITH {_RANKS}, a AS (SELECT nation, model, avg(rank) AS average_rank FROM rnk GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY average_rank, model) AS rn, count(*) OVER (PARTITION BY nation) AS total_models FROM a)
SELECT nation, model AS best_model, average_rank, total_models FROM o WHERE rn = 1""",
)
def _best(spark, sf):
    return metrics.model_best(metrics.forecast_metrics(_pairs(spark, sf), BY), ["nation"])


_PIVOTED = ", ".join(f"max(value) FILTER (model = '{m}') AS {m}" for m in forecasting.PATH_MODELS)
_LONG4 = " UNION ALL ".join(f"SELECT nation, '{m}' AS metric, model, {m} AS value FROM bas" for m in ("mae", "rmse", "mape", "r2"))


@query(
    "metrics_pivot",
    "nation:i metric:s recent_slope:6 seasonal_path:6 trend:6",
    f"WITH {_SCORES}, lng AS ({_LONG4}) SELECT nation, metric, {_PIVOTED} FROM lng GROUP BY 1, 2",
)
def _pivot(spark, sf):
    scores = metrics.forecast_metrics(_pairs(spark, sf), BY)
    return metrics.metrics_pivot(scores, forecasting.PATH_MODELS, ["nation"])


# ---- cross-validation -------------------------------------------------------------------------

_IDX = "ix AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY nation) AS n FROM nm)"
_CUTS = f"""{NATION_M}, {_IDX},
sz AS (SELECT nation, count(*) AS n FROM nm GROUP BY 1),
cuts AS (SELECT nation, n, f AS fold, n // 2 + f * 3 AS cut FROM sz, range(0, 1000) AS r(f) WHERE n // 2 + f * 3 <= n - 6)"""


@query(
    "cv_folds",
    "nation:i fold:i cut:i n_train:i ts:d y:2",
    f"WITH {_CUTS} SELECT c.nation, fold, cut, cut AS n_train, ts, y FROM cuts c JOIN ix ON ix.nation = c.nation AND idx >= cut AND idx < cut + 6",
)
def _folds(spark, sf):
    rows = crossval.fold_tests(panels.nation_monthly(spark, sf), ["nation"], horizon=6, step=3)
    return rows.withColumn("n_train", F.col("cut"))


@query("cv_fold_cuts", "nation:i fold:i cut:i n:i", f"WITH {_CUTS} SELECT * FROM cuts")
def _cuts(spark, sf):
    return crossval.fold_cuts(panels.nation_monthly(spark, sf), ["nation"], horizon=6, step=3)


_CV_LINES = f"""{_CUTS},
ln AS (SELECT c.nation, fold, cut, regr_slope(y, idx) AS slope, regr_intercept(y, idx) AS intercept FROM cuts c JOIN ix ON ix.nation = c.nation AND idx < cut GROUP BY ALL),
cv AS (SELECT ln.nation, fold, cut, ts, y, intercept + slope * idx AS yhat FROM ln JOIN ix ON ix.nation = ln.nation AND idx >= cut AND idx < cut + 6)"""


@query(
    "cv_train_sizes",
    "nation:i fold:i n_train:i first_ts:d last_ts:d total:2",
    f"""WITH {_CUTS} SELECT c.nation, fold, count(*) AS n_train, min(ts) AS first_ts, max(ts) AS last_ts, sum(y) AS total
FROM cuts c JOIN ix ON ix.nation = c.nation AND idx < cut GROUP BY 1, 2""",
)
def _train_sizes(spark, sf):
    rows = crossval.fold_train(panels.nation_monthly(spark, sf), ["nation"], horizon=6, step=3)
    return rows.groupBy("nation", "fold").agg(
        F.count("*").alias("n_train"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("y").alias("total")
    )


@query(
    "cv_cutoff_sizes",
    "nation:i fold:i n_train:i n_test:i last_train:d last_test:d",
    f"""WITH {NATION_M}, s AS (SELECT nation, CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi FROM nm GROUP BY 1),
k AS (SELECT nation, k AS fold, hi - CAST(365 + 180 * k AS INTEGER) AS cutoff, hi - CAST(180 * k AS INTEGER) AS horizon_end FROM s, range(0, 1000) AS r(k)
  WHERE hi - CAST(365 + 180 * k AS INTEGER) >= lo + 730)
SELECT k.nation, fold, count(*) FILTER (ts <= cutoff) AS n_train, count(*) FILTER (ts > cutoff AND ts <= horizon_end) AS n_test,
  max(ts) FILTER (ts <= cutoff) AS last_train, max(ts) FILTER (ts > cutoff AND ts <= horizon_end) AS last_test
FROM k JOIN nm USING (nation) GROUP BY 1, 2""",
)
def _cutoff_sizes(spark, sf):
    train, test = crossval.cutoff_parts(panels.nation_monthly(spark, sf), ["nation"])
    left = train.groupBy("nation", "fold").agg(F.count("*").alias("n_train"), F.max("ts").alias("last_train"))
    right = test.groupBy("nation", "fold").agg(F.count("*").alias("n_test"), F.max("ts").alias("last_test"))
    return left.join(right, ["nation", "fold"])


@query("cv_linear_trend", "nation:i fold:i cut:i ts:d y:2 yhat:2", f"WITH {_CV_LINES} SELECT * FROM cv")
def _cv_trend(spark, sf):
    return crossval.cv_linear_trend(panels.nation_monthly(spark, sf), ["nation"])


@query(
    "cv_scores",
    "nation:i n_folds:i avg_mae:2 std_mae:2 avg_rmse:2 std_rmse:2 avg_mape:6 std_mape:6",
    f"""WITH {_CV_LINES}, f AS ({_basic_sql('nation, fold', 'cv')})
SELECT nation, count(*) AS n_folds, avg(mae) AS avg_mae, stddev_pop(mae) AS std_mae, avg(rmse) AS avg_rmse, stddev_pop(rmse) AS std_rmse,
  avg(mape) AS avg_mape, stddev_pop(mape) AS std_mape FROM f GROUP BY 1""",
)
def _cv_scores(spark, sf):
    return crossval.cv_scores(crossval.cv_linear_trend(panels.nation_monthly(spark, sf), ["nation"]), ["nation"])


@query(
    "cv_cutoffs",
    "nation:i cutoff:d horizon_end:d",
    f"""WITH {NATION_M}, s AS (SELECT nation, CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi FROM nm GROUP BY 1)
SELECT nation, hi - CAST(365 + 180 * k AS INTEGER) AS cutoff, hi - CAST(180 * k AS INTEGER) AS horizon_end FROM s, range(0, 1000) AS r(k)
WHERE hi - CAST(365 + 180 * k AS INTEGER) >= lo + 730""",
)
def _cutoffs(spark, sf):
    return crossval.cv_cutoffs(panels.nation_monthly(spark, sf), ["nation"])


@query(
    "holdout_split",
    "nation:i ts:d y:2 idx:i n:i split:i is_train:b",
    f"WITH {_PAIRS} SELECT *, idx < split AS is_train FROM ho",
)
def _split(spark, sf):
    return crossval.holdout_split(panels.nation_monthly(spark, sf), ["nation"])


@query(
    "series_eligibility",
    "part:i n_rows:i eligible:b status:s",
    f"""WITH {PART_M} SELECT part, count(*) AS n_rows, count(*) >= 60 AS eligible,
  CASE WHEN count(*) >= 60 THEN 'ok' ELSE 'needs 60 rows' END AS status FROM ptm GROUP BY 1""",
)
def _eligible(spark, sf):
    return crossval.series_eligibility(panels.part_monthly(spark, sf), ["part"], min_rows=60)


# ---- ensembles --------------------------------------------------------------------------------

_FUTURE = f"""{_SCORES},
ff AS (SELECT nation, max(ts) AS last_ts, count(*) AS n, arg_max(y, ts) AS last_value, regr_slope(y, idx) AS slope, regr_intercept(y, idx) AS intercept,
  regr_slope(y, idx) FILTER (idx >= n - 12) AS slope12 FROM ho GROUP BY 1),
fs AS (SELECT *, last_day(date_trunc('month', last_ts) + to_months(CAST(step AS INTEGER))) AS ds FROM ff, range(1, 13) AS r(step)),
fc_any AS (SELECT nation, 'recent_slope' AS model, step, ds, last_value + step * slope12 AS yhat FROM fs
  UNION ALL SELECT nation, 'seasonal_path', step, ds, last_value + step * slope12 * (1 + 0.1 * sin(2 * pi() * (step - 1 + month(last_ts)) / 12)) FROM fs
  UNION ALL SELECT nation, 'trend', step, ds, intercept + slope * (n - 1 + step) FROM fs),
fc AS (SELECT nation, model, step, ds, round(yhat, 2) AS yhat FROM fc_any),
ew AS (SELECT nation, model, (1 / (mape + 1)) / sum(1 / (mape + 1)) OVER (PARTITION BY nation) AS weight FROM bas)"""


def _future(spark, sf):
    paths = forecasting.future_paths(panels.nation_monthly(spark, sf), ["nation"])
    return paths.withColumn("yhat", F.round("yhat", 2))


def _weights(spark, sf):
    scores = metrics.forecast_metrics(_pairs(spark, sf), BY)
    return ensemble.ensemble_weights(scores, ["nation"])


@query("future_paths", "nation:i model:s step:i ds:d yhat:2", f"WITH {_FUTURE} SELECT * FROM fc")
def _future_paths(spark, sf):
    return _future(spark, sf)


@query(
    "ensemble_simple",
    "nation:i step:i ds:d n_models:i yhat:4",
    f"WITH {_FUTURE} SELECT nation, step, ds, count(*) AS n_models, avg(yhat) AS yhat FROM fc GROUP BY ALL",
)
def _simple(spark, sf):
    return ensemble.simple_average(_future(spark, sf), ["nation"])


@query("ensemble_weights", "nation:i model:s weight:6", f"WITH {_FUTURE} SELECT * FROM ew")
def _ensemble_weights(spark, sf):
    return _weights(spark, sf)


@query(
    "ensemble_weighted",
    "nation:i step:i ds:d n_models:i yhat:2",
    f"""WITH {_FUTURE} SELECT nation, step, ds, count(*) AS n_models, sum(weight * yhat) / sum(weight) AS yhat
FROM fc JOIN ew USING (nation, model) GROUP BY ALL""",
)
def _weighted(spark, sf):
    return ensemble.weighted_average(_future(spark, sf), _weights(spark, sf), ["nation"])


@query(
    "ensemble_intervals",
    "nation:i step:i ds:d n_models:i yhat:4 lower:2 upper:2",
    f"""WITH {_FUTURE} SELECT nation, step, ds, count(*) AS n_models, avg(yhat) AS yhat, avg(yhat) - 1.96 * stddev_pop(yhat) AS lower,
  avg(yhat) + 1.96 * stddev_pop(yhat) AS upper FROM fc GROUP BY ALL""",
)
def _ensemble_intervals(spark, sf):
    return ensemble.ensemble_intervals(_future(spark, sf), ["nation"])


@query(
    "ensemble_contributions",
    "nation:i model:s mape:6 weight:6 weight_rank:i",
    f"""WITH {_FUTURE} SELECT nation, model, mape, weight, row_number() OVER (PARTITION BY nation ORDER BY weight DESC, model) AS weight_rank
FROM bas JOIN ew USING (nation, model)""",
)
def _contributions(spark, sf):
    scores = metrics.forecast_metrics(_pairs(spark, sf), BY)
    return ensemble.contributions(scores, ensemble.ensemble_weights(scores, ["nation"]), ["nation"])


# ---- calendar effects of the additive model ------------------------------------------------------


def _fourier_sql() -> str:
    cols = []
    for name, (period, order) in {"yearly": (365.25, 2), "quarterly": (91.25, 1)}.items():
        for k in range(1, order + 1):
            arg = f"2 * pi() * {k} * date_diff('day', DATE '1970-01-01', ts) / {period}"
            cols += [f"sin({arg}) AS {name}_sin_{k}", f"cos({arg}) AS {name}_cos_{k}"]
    return ", ".join(cols)


@query(
    "fourier_features",
    "nation:i ts:d yearly_sin_1:6 yearly_cos_1:6 yearly_sin_2:6 yearly_cos_2:6 quarterly_sin_1:6 quarterly_cos_1:6",
    f"WITH {NATION_ALL} SELECT nation, ts, {_fourier_sql()} FROM nm",
)
def _fourier(spark, sf):
    return calendar_effects.fourier_features(panels.nation_monthly(spark, sf, closed=False), {"yearly": (365.25, 2), "quarterly": (91.25, 1)})


@query(
    "changepoint_features",
    "nation:i ts:d t:6 hinge_1:6 hinge_2:6 hinge_3:6 hinge_4:6",
    f"""WITH {NATION_ALL}, s AS (SELECT nation, min(ts) AS lo, max(ts) AS hi FROM nm GROUP BY 1),
t AS (SELECT nation, ts, date_diff('day', lo, ts)::DOUBLE / date_diff('day', lo, hi) AS t FROM nm JOIN s USING (nation))
SELECT nation, ts, t, greatest(t - 0.2, 0) AS hinge_1, greatest(t - 0.4, 0) AS hinge_2, greatest(t - 0.6000000000000001, 0) AS hinge_3, greatest(t - 0.8, 0) AS hinge_4 FROM t""",
)
def _changepoints(spark, sf):
    return calendar_effects.changepoint_features(panels.nation_monthly(spark, sf, closed=False), 4, ["nation"])


@query(
    "holiday_join",
    "o_orderdate:d holiday:s is_holiday:i orders:i",
    """WITH h AS (SELECT * FROM (VALUES (1, 1, 'new year'), (5, 1, 'labour day'), (12, 25, 'christmas'), (12, 26, 'christmas'), (12, 26, 'boxing day')) AS v(m, d, holiday)),
o AS (SELECT CAST(o_orderdate AS DATE) AS o_orderdate, count(*) AS orders FROM orders GROUP BY 1),
cal AS (SELECT make_date(CAST(y AS BIGINT), m, d) AS ds, string_agg(DISTINCT holiday, ', ' ORDER BY holiday) AS holiday
  FROM h, (SELECT DISTINCT year(o_orderdate) AS y FROM orders) GROUP BY 1)
SELECT o_orderdate, holiday, CASE WHEN holiday IS NULL THEN 0 ELSE 1 END AS is_holiday, orders FROM o LEFT JOIN cal ON ds = o_orderdate""",
)
def _holidays(spark, sf):
    orders = table(spark, sf, "orders")
    days = orders.groupBy(F.to_date("o_orderdate").alias("o_orderdate")).agg(F.count("*").alias("orders"))
    fixed = F.expr("array(named_struct('m', 1, 'd', 1, 'holiday', 'new year'), named_struct('m', 5, 'd', 1, 'holiday', 'labour day'), "
                   "named_struct('m', 12, 'd', 25, 'holiday', 'christmas'), named_struct('m', 12, 'd', 26, 'holiday', 'christmas'), "
                   "named_struct('m', 12, 'd', 26, 'holiday', 'boxing day'))")
    years = orders.select(F.year("o_orderdate").alias("y")).distinct().select("y", F.explode(fixed).alias("h"))
    holidays = years.select(F.make_date("y", F.col("h.m"), F.col("h.d")).alias("ds"), F.col("h.holiday").alias("holiday"))
    return calendar_effects.holiday_join(days, holidays, "o_orderdate")
