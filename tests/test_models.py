"""Fitted models against plain numpy and against series with a known answer."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import CHAMPAGNE, month, one
from tidemill.operators import additive, arima, calendar_effects, lagreg, lookback
from tidemill.operators.crossval import series_eligibility
from tidemill.plans import forecasting
from tidemill.plans.queries_models import members

Y = np.array(CHAMPAGNE, dtype=float)


def frame(spark, values, start=(2000, 1)):
    return spark.createDataFrame([(month(i, start), float(v)) for i, v in enumerate(values)], "ts date, y double")


def mape(actual, predicted):
    return float(np.mean(np.abs((np.array(actual) - np.array(predicted)) / np.array(actual)))) * 100


# ---- ARIMA ---------------------------------------------------------------------------


def loop_residuals(z, ar, ma):
    e = np.zeros(len(z))
    for t in range(len(z)):
        e[t] = z[t] - sum(a * z[t - i - 1] for i, a in enumerate(ar) if t - i - 1 >= 0)
        e[t] -= sum(m * e[t - j - 1] for j, m in enumerate(ma) if t - j - 1 >= 0)
    return e


def test_css_residuals_equal_a_plain_loop():
    rng = np.random.default_rng(0)
    z = rng.normal(size=40)
    layout = arima.Layout(2, 1, 1, 1, 4)
    params = np.array([[0.5, -0.2, 0.3, 0.4, -0.6]])
    ar, ma = layout.weights(params)
    # (1 - .5B + .2B2)(1 - .4B4) and (1 + .3B)(1 - .6B4), multiplied out
    assert np.allclose(ar[0], [0.5, -0.2, 0, 0.4, -0.2, 0.08]) and np.allclose(ma[0], [0.3, 0, 0, -0.6, -0.18])
    assert np.allclose(arima.css_residuals(z, params, layout)[0], loop_residuals(z, ar[0], ma[0]))


def test_css_fit_recovers_coefficients():
    rng = np.random.default_rng(1)
    e = rng.normal(size=3000)
    z = np.zeros(3000)
    for t in range(1, 3000):
        z[t] = 0.6 * z[t - 1] + e[t] + 0.4 * e[t - 1]
    layout = arima.Layout(1, 1, 0, 0, 12)
    params, sse = arima.css_fit(z, layout.mask(1, 1, 0, 0)[None, :], layout)
    assert params[0] == pytest.approx([0.6, 0.4], abs=0.06) and sse[0] / 3000 == pytest.approx(1.0, abs=0.08)


def test_batch_fit_equals_single_fits():
    z = arima.difference(np.log(Y), 1, 1, 12)
    layout = arima.Layout(1, 1, 1, 1, 12)
    masks = np.array([layout.mask(*m) for m in ((1, 0, 0, 0), (0, 1, 0, 1), (1, 1, 1, 1))])
    _, together = arima.css_fit(z, masks, layout)
    alone = [arima.css_fit(z, m[None, :], layout)[1][0] for m in masks]
    assert together == pytest.approx(alone, rel=1e-4)


def test_arima_repeats_a_pure_season_and_a_line(spark):
    values = [100 + 2 * i + 30 * np.sin(2 * np.pi * i / 12) for i in range(60)]
    got = arima.arima_forecast(frame(spark, values)).orderBy("step").collect()
    expected = [100 + 2 * i + 30 * np.sin(2 * np.pi * i / 12) for i in range(60, 72)]
    assert [r.yhat for r in got] == pytest.approx(expected, rel=1e-3)
    assert [str(r.ds) for r in got[:2]] == ["2005-01-31", "2005-02-28"]


def test_arima_forecasts_champagne(series):
    train = series.where("ts < '1971-10-01'")
    rows = arima.arima_forecast(train).orderBy("step").collect()
    assert mape(Y[-12:], [r.yhat for r in rows]) < 15
    width = [r.upper - r.lower for r in rows]
    assert all(w > 0 for w in width) and width[-1] >= width[0]
    inside = sum(r.lower <= a <= r.upper for r, a in zip(rows, Y[-12:]))
    assert inside >= 10


def test_short_series_are_reported(spark):
    got = arima.arima_forecast(frame(spark, [1, 2, 3])).collect()
    assert {r.status for r in got} == {"short"} and {r.yhat for r in got} == {3.0}


def test_exogenous_regressor(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=84)
    noise = np.cumsum(rng.normal(size=84) * 0.1)
    df = frame(spark, noise[:72] + 5 * x[:72] + 50).withColumn("i", F.months_between("ts", F.lit("2000-01-01")).cast("int"))
    lookup = F.array(*[F.lit(float(v)) for v in x])
    df = df.withColumn("x", lookup[F.col("i")]).drop("i")
    ahead = spark.range(1, 13).select(F.col("id").cast("int").alias("step")).withColumn("x", lookup[F.col("step") + 71])
    got = [r.yhat for r in arima.arima_forecast(df, exog=["x"], future_exog=ahead).orderBy("step").collect()]
    plain = [r.yhat for r in arima.arima_forecast(df).orderBy("step").collect()]
    actual = noise[72:] + 5 * x[72:] + 50
    assert np.abs(np.array(got) - actual).mean() < 0.3 * np.abs(np.array(plain) - actual).mean()
    with pytest.raises(ValueError):
        arima.arima_forecast(df, exog=["x"])


def test_order_search_covers_every_candidate(panel):
    found = arima.order_search(panel, ["k"]).cache()
    assert found.count() == 2 * 864 and found.where("status = 'success'").count() > 1700
    assert found.select("k", "p", "d", "q", "sp", "sd", "sq").distinct().count() == 2 * 864
    best = arima.best_orders(found, ["k"])
    for row in best.collect():
        peers = found.where((F.col("k") == row.k) & (F.col("d") == row.d) & (F.col("sd") == row.sd))
        assert row.aic == peers.agg(F.min("aic").alias("m")).first().m
        assert row.sd == 1  # a strong season is differenced away
    lowest = arima.best_orders(found, ["k"], rule="aic")
    assert {r.k: r.aic for r in lowest.collect()} == {r.k: r.m for r in found.groupBy("k").agg(F.min("aic").alias("m")).collect()}
    forecast = arima.arima_forecast(panel, ["k"], orders=best)
    assert forecast.count() == 24 and forecast.where("status = 'success'").count() == 24


# ---- additive --------------------------------------------------------------------------


def test_additive_components_add_up_and_fit(panel):
    got = additive.additive_fit(panel, ["k"], 12).toPandas()
    total = got[["trend", "yearly", "monthly", "quarterly"]].sum(axis=1)
    assert np.allclose(total, got["yhat"]) and (got["step"] > 0).sum() == 24
    past = got[got["step"] == 0]
    assert mape(past["y"], past["yhat"]) < 12


def test_additive_forecast_quality(series):
    rows = additive.additive_forecast(series.where("ts < '1971-10-01'")).orderBy("step").collect()
    assert mape(Y[-12:], [r.yhat for r in rows]) < 30 and [str(r.ds) for r in rows[:1]] == ["1971-10-31"]


def test_only_resolvable_seasons_are_used():
    config = additive.AdditiveConfig()
    assert [config.usable_order(*config.seasonalities()[n]) for n in ("yearly", "quarterly", "monthly")] == [6, 1, 0]
    daily = additive.AdditiveConfig(freq="D", weekly=True)
    assert [daily.usable_order(*v) for v in daily.seasonalities().values()] == [10, 3, 5, 4]
    assert additive.AdditiveConfig(resolvable_only=False).usable_order(30.5, 5) == 5


def test_additive_multiplicative_mode(spark):
    values = [np.exp(0.02 * i) * (2 + np.sin(2 * np.pi * i / 12)) for i in range(72)]
    config = additive.AdditiveConfig(mode="multiplicative", extra={})
    got = additive.additive_fit(frame(spark, values), [], 6, config).toPandas().sort_values("ts")
    assert mape(got["y"][:72], got["yhat"][:72]) < 5
    assert np.allclose(got["trend"] * got["yearly"], got["yhat"])


def test_changepoint_is_found_where_the_slope_turns(spark):
    values = [10 * i if i < 40 else 400 - 10 * (i - 40) for i in range(80)]
    config = additive.AdditiveConfig(yearly=False, extra={}, changepoint_scale=5.0)
    rows = additive.changepoints(frame(spark, values), [], config).collect()
    strongest = max(rows, key=lambda r: abs(r.delta))
    assert strongest.significant and abs(strongest.position - 0.5) < 0.06 and strongest.delta < 0


def test_importance_shares_sum_to_100(panel):
    rows = additive.additive_importance(panel, ["k"]).groupBy("k").agg(F.sum("importance").alias("s")).collect()
    assert [r.s for r in rows] == pytest.approx([100.0, 100.0])


def test_holidays(spark):
    values = [50.0 + (40 if i % 6 == 0 else 0) for i in range(48)]
    df = frame(spark, values)
    days = spark.createDataFrame([(month(i, (2000, 1)), "fair") for i in range(0, 60, 6)], "ds date, holiday string")
    config = additive.AdditiveConfig(yearly=False, extra={}, changepoints=1)
    rows = additive.additive_fit(df, [], 12, config, days, ["fair"]).where("step > 0").orderBy("step").collect()
    assert [round(r.holidays) for r in rows] == [40 if i % 6 == 0 else 0 for i in range(48, 60)]
    joined = calendar_effects.holiday_join(df, days)
    assert joined.count() == 48 and joined.where("is_holiday = 1").count() == 8


# ---- lag regression ----------------------------------------------------------------------


def test_next_features_equal_the_spark_features(series):
    rows, names = lagreg.lagged_frame(series)
    expected = dict(zip(names, rows.orderBy(F.desc("ts")).first().x))
    got = lagreg.next_features(Y[None, -13:-1], np.array([104]), np.array([1972 * 12 + 8]))
    assert set(got) == set(names)
    for name in names:
        assert got[name][0] == pytest.approx(expected[name]), name


@pytest.mark.parametrize("kind,alpha", [("linear", 1.0), ("ridge", 10.0), ("lasso", 5.0)])
def test_lag_regression_solves_its_problem(series, kind, alpha):
    fitted = one(lagreg.lag_regression_fit(series, model=lagreg.LagRegression(kind, alpha, n_features=5)))
    rows, names = lagreg.lagged_frame(series)
    data = rows.orderBy("ts").toPandas()
    x = np.vstack(data["x"])[:, [names.index(f) for f in fitted.features]]
    z, y = (x - x.mean(0)) / x.std(0), data["y"].to_numpy() - data["y"].mean()
    beta = np.array(fitted.coef)
    pull = z.T @ (y - z @ beta)
    if kind == "linear":
        assert np.allclose(pull, 0, atol=1e-5)
    elif kind == "ridge":
        assert np.allclose(pull, alpha * beta, atol=1e-5)
    else:
        active = beta != 0
        assert np.allclose(pull[active] / len(y), alpha * np.sign(beta[active]), atol=1e-4)
        assert np.all(np.abs(pull[~active]) / len(y) <= alpha + 1e-6)
    assert fitted.r2 == pytest.approx(1 - ((y - z @ beta) ** 2).sum() / (y**2).sum()) and fitted.n_rows == 93


def test_pooled_ridge_equals_the_closed_form(panel):
    features = ["y_lag_1", "y_lag_12", "month_sin"]
    model, names = lagreg.pooled_lag_regression(panel, ["k"], kind="ridge", alpha=3.0, features=features)
    parts = []
    for (_k,), g in panel.toPandas().sort_values("ts").groupby(["k"]):
        v = g["y"] / g["y"].mean()
        m = np.array([t.month for t in g["ts"]])
        parts.append(np.column_stack([v, v.shift(1), v.shift(12), np.sin(2 * np.pi * m / 12)])[12:])
    data = np.vstack(parts)
    z, y = (data[:, 1:] - data[:, 1:].mean(0)) / data[:, 1:].std(0), data[:, 0] - data[:, 0].mean()
    assert names == features
    assert np.allclose(model.coefficients.toArray(), np.linalg.solve(z.T @ z + 3 * np.eye(3), z.T @ y), atol=1e-8)


def test_lag_regression_forecast_and_importance(panel):
    model = lagreg.LagRegression("ridge", 1.0, degree=2, n_features=4)
    fitted = lagreg.lag_regression_fit(panel, ["k"], model=model).cache()
    assert one(fitted.where("k = 'a'")).features[4:] and fitted.first().n_nonzero <= 10
    got = lagreg.lag_regression_forecast(panel, ["k"], 6, models=fitted)
    assert got.count() == 12 and got.where("lower < yhat and yhat < upper").count() == 12
    top = lagreg.coefficient_importance(fitted, ["k"], 3).collect()
    assert len(top) == 6 and all(r.importance == abs(r.coef) for r in top)
    plain = lagreg.lag_regression_forecast(panel, ["k"], 12).where("k = 'a'").orderBy("step").collect()
    assert mape(Y[-12:], [r.yhat for r in plain]) < 40


# ---- look-back, jobs -----------------------------------------------------------------------


def test_lookback_learns_a_repeating_pattern(spark):
    values = [10, 20, 30, 15] * 20
    got = lookback.lookback_forecast(frame(spark, values), [], 8).orderBy("step").collect()
    assert [r.yhat for r in got] == pytest.approx([10, 20, 30, 15] * 2, abs=1.5)
    assert all(r.lower <= r.yhat <= r.upper for r in got)


def test_fit_job_scores_weighs_combines_and_reloads(spark, panel, tmp_path):
    chosen = {m: f for m, f in members().items() if m != "additive"}
    fitted = forecasting.fit(panel, chosen, ["k"], 6, test_horizon=21)
    fitted.save(str(tmp_path / "fit"))
    again = forecasting.FittedPanel.load(spark, str(tmp_path / "fit"), ["k"])
    weights = again.weights.groupBy("k").agg(F.sum("weight").alias("w")).collect()
    assert [r.w for r in weights] == pytest.approx([1.0, 1.0])
    combined = again.combined().collect()
    assert len(combined) == 12 and all(r.n_models == 2 and r.lower < r.yhat < r.upper for r in combined)
    assert again.contributions().count() == 4
    assert again.combined("simple").count() == 12


def test_short_series_are_left_out_and_listed(spark, panel):
    short = panel.unionByName(panel.where("k = 'a' and ts < '1965-01-01'").withColumn("k", F.lit("c")))
    status = {r.k: r.status for r in series_eligibility(short, ["k"]).collect()}
    assert status == {"a": "ok", "b": "ok", "c": "needs 24 rows"}
    fitted = forecasting.fit(short, {"arima": members()["arima"]}, ["k"], 3, scored=False)
    assert {r.k for r in fitted.forecasts.collect()} == {"a", "b"}


def test_a_member_without_predictions_weighs_nothing(panel):
    broken = lambda df, keys, h: members()["arima"](df, keys, h).where("k = 'a'")
    scores = forecasting.holdout_scores(panel, {"arima": members()["arima"], "broken": broken}, ["k"], 21)
    status = {(r.k, r.model): r.status for r in scores.collect()}
    assert status[("b", "broken")] == "failed" and list(status.values()).count("success") == 3


def test_cross_validation_refits_every_fold(series, panel):
    pairs = forecasting.cross_validate(panel, {"arima": members()["arima"]}, ["k"], horizon=6, step=6).cache()
    cut = 52 + 2 * 6
    rows = pairs.where("k = 'a' and fold = 2").orderBy("step").collect()
    alone = arima.arima_forecast(series.orderBy("ts").limit(cut), [], 6).orderBy("step").collect()
    assert [r.yhat for r in rows] == pytest.approx([r.yhat for r in alone]) and [r.y for r in rows] == list(Y[cut : cut + 6])
    assert pairs.groupBy("k").agg(F.count_distinct("fold").alias("f")).where("k = 'a'").first().f == len(range(52, 100, 6))


def test_cutoff_validation_uses_every_cutoff(panel):
    pairs = forecasting.cross_validate_cutoffs(panel, {"arima": members()["arima"]}, ["k"], max_step=13)
    last = {r.k: r.t for r in pairs.where("fold = 0").groupBy("k").agg(F.max("ts").alias("t")).collect()}
    assert {str(t) for t in last.values()} == {"1972-09-01"}
    assert pairs.groupBy("k", "fold").count().where("count < 12 or count > 13").count() == 0
