"""Models as tables: forecasts from saved tables, fits on appended rows, sums of products, fit statistics."""

from __future__ import annotations

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import CHAMPAGNE, month
from tidemill.operators import additive, arima, gram, lagreg, metrics
from tidemill.plans import forecasting, model_store

Y = np.array(CHAMPAGNE, dtype=float)


@pytest.fixture(scope="module")
def wide(spark):
    """Three keys, one of them null and one too short for any window."""
    rows = [(k, month(i), float(v) * f + i) for k, f in (("a", 1.0), (None, 3.0)) for i, v in enumerate(CHAMPAGNE)]
    rows += [("short", month(i), float(i)) for i in range(5)]
    return spark.createDataFrame(rows, "k string, ts date, y double").cache()


def by_row(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


def same(left, right, order, numbers, rel=1e-9):
    a, b = by_row(left, *order), by_row(right, *order)
    assert len(a) == len(b) > 0
    for c in numbers:
        assert a[c].to_numpy(dtype=float) == pytest.approx(b[c].to_numpy(dtype=float), rel=rel, abs=1e-6, nan_ok=True), c


# ---- sums of products ---------------------------------------------------------------


def test_gram_equals_numpy_and_adds_up(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 4)) * [1, 100, 0, 5] + [0, 1e4, 7, 0]
    y = rng.normal(size=90)
    rows = [(k % 3 or None, x[k].tolist(), float(y[k])) for k in range(90)] + [(1, [1.0, None, 2.0, 3.0], 4.0), (1, [0.0] * 4, None)]
    df = spark.createDataFrame(rows, "k int, x array<double>, y double")
    got = {r.k: np.array(r.gram) for r in gram.gram_sums(df, ["k"], "x", "y", 4).collect()}
    for k in (None, 1, 2):
        own = [i for i in range(90) if (i % 3 or None) == k]
        z = np.column_stack([np.ones(len(own)), x[own], y[own]])
        assert got[k] == pytest.approx((z.T @ z).ravel(), rel=1e-12)
    halves = [gram.gram_sums(df.where(c), [], "x", "y", 4).withColumnRenamed("gram", n) for c, n in (("y > 0", "a"), ("y <= 0", "b"))]
    both = halves[0].crossJoin(halves[1]).select(gram.added(F.col("a"), F.col("b")).alias("g")).first().g
    assert both == pytest.approx(gram.gram_sums(df, [], "x", "y", 4).first().gram, rel=1e-12)
    sums = gram.Moments(got[1])
    assert sums.width[2] == 1.0 and sums.correlations()[2] == -1.0  # the column that does not vary


@pytest.mark.parametrize(("kind", "alpha"), [("linear", 1.0), ("ridge", 7.0), ("lasso", 40.0)])
def test_sums_solve_the_same_problem_as_the_rows(spark, wide, kind, alpha):
    model = lagreg.LagRegression(kind, alpha)
    rows, names = lagreg.lagged_frame(wide, ["k"])
    fields = ["intercept", "resid_std", "r2", "mae", "rmse", "n_rows"]
    fitted, plain = lagreg.lag_regression_fit(wide, ["k"], model=model), lagreg._fit_products(rows, ["k"], "ts", names, model)
    same(fitted, plain, ["intercept"], fields, 1e-6)
    for a, b in zip(by_row(fitted, "intercept").itertuples(), by_row(plain, "intercept").itertuples()):
        assert list(a.features) == list(b.features) and np.allclose(a.coef, b.coef, rtol=1e-5, atol=1e-4 * np.abs(b.coef).max())
    plan = lagreg.lag_regression_fit(wide, ["k"], model=model)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsIn" not in plan and "collect_list(x" not in plan


def test_plain_solvers():
    rng = np.random.default_rng(3)
    z = rng.normal(size=(50, 3))
    z = np.column_stack([z, z[:, 0] - z[:, 1]])
    z = (z - z.mean(0)) / z.std(0)
    y = z @ [1.0, 2.0, 0.0, 0.5] + rng.normal(size=50) * 0.1
    y -= y.mean()
    products, target = z.T @ z / 50, z.T @ y / 50
    assert np.allclose(z @ gram.least_squares(products, target), z @ np.linalg.lstsq(z, y, rcond=None)[0])
    assert np.allclose(gram.ridge(products, target, 3.0, 50), np.linalg.solve(z.T @ z + 3 * np.eye(4), z.T @ y))
    b = gram.lasso(products, target, 0.3)
    pull = target - products @ b
    assert np.all(np.abs(pull) <= 0.3 + 1e-6) and np.allclose(pull[b != 0], 0.3 * np.sign(b[b != 0]), atol=1e-6)


# ---- fit once, forecast later --------------------------------------------------------


def test_saved_models_forecast_as_fresh_ones(spark, wide, tmp_path):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    trained = model_store.train(wide, keys=["k"])
    trained.save(path)
    loaded = model_store.TrainedPanel.load(spark, path)
    assert loaded.version == 1 and loaded.keys == ["k"] and set(loaded.tables) == set(model_store.families())
    for horizon in (3, 17):
        got = loaded.forecast(horizon).cache()
        fresh = {
            "arima": arima.arima_forecast(wide, ["k"], horizon),
            "lag_regression": lagreg.lag_regression_forecast(wide, ["k"], horizon, model=lagreg.LagRegression("ridge")),
            "additive": additive.additive_forecast(wide, ["k"], horizon),
        }
        for name, frame in fresh.items():
            same(got.where(F.col("model") == name), frame, ["step", "yhat"], ["yhat", "lower", "upper"])
        paths = forecasting.future_paths(wide, ["k"], horizon=horizon)
        same(got.where(F.col("model").isin(*forecasting.PATH_MODELS)), paths, ["model", "step", "yhat"], ["yhat"])
        assert {str(r.ds) for r in got.where("step = 1 AND k = 'a'").collect()} == {"1972-10-31"}
    info = by_row(loaded.info(), "model", "n_rows")
    assert info[info.model == "arima"].n_rows.tolist() == [0, 92, 92] and info[info.model == "trend"].n_rows.tolist() == [5, 105, 105]
    assert set(info[info.model == "lag_regression"].status) == {"short", "success"} and set(info.version) == {1}
    assert loaded.combined(4).count() == 12  # the paths forecast the short series too
    with pytest.raises(ValueError, match="not known"):
        model_store.TrainedPanel.load(spark, path, {"trend": model_store.path_family("trend")})


def test_retrained_equals_trained_on_everything(spark, wide):
    names = ("trend", "recent_slope", "seasonal_path", "lag_regression")
    chosen = {n: f for n, f in model_store.families().items() if n in names}
    newcomer = spark.createDataFrame([("new", month(60 + i), 50.0 + i * i) for i in range(40)], "k string, ts date, y double")
    whole = wide.unionByName(newcomer)
    # "a" and the null key get later rows, "short" gets none, "new" appears; the rows of one year come twice
    first, later = wide.where("ts < '1970-01-01'"), whole.where("ts >= '1969-01-01'")
    again = model_store.train(first, chosen, ["k"]).retrain(later)
    full = model_store.train(whole, chosen, ["k"])
    assert again.version == 2
    same(again.forecast(9), full.forecast(9), ["model", "step", "yhat"], ["yhat", "lower", "upper"], 1e-7)
    same(again.tables["lag_regression"], full.tables["lag_regression"], ["n", "intercept"], ["n", "intercept", "resid_std", "r2", "n_rows"])
    grams = [by_row(t.tables["lag_regression"].where("gram IS NOT NULL"), "n", "intercept").gram for t in (again, full)]
    assert all(np.allclose(a, b, rtol=1e-9) for a, b in zip(*grams))
    # step by step, one row at a time, too
    one = model_store.train(wide.where("ts < '1972-07-01'"), chosen, ["k"])
    for day in ("1972-07-01", "1972-08-01", "1972-09-01"):
        one = one.retrain(wide.where(F.col("ts") == day))
    assert one.version == 4
    same(one.forecast(5), model_store.train(wide, chosen, ["k"]).forecast(5), ["model", "step", "yhat"], ["yhat"], 1e-7)


def test_retraining_reads_new_rows_only(spark, wide, tmp_path):
    path, new = f"{tmp_path}/old", f"{tmp_path}/new"
    wide.where("ts < '1970-01-01'").write.parquet(path)
    wide.where("ts >= '1970-01-01'").write.parquet(new)
    trained = model_store.train(spark.read.parquet(path), {"lag_regression": model_store.lag_family()}, ["k"])
    plan = lagreg.lag_regression_retrain(trained.tables["lag_regression"], spark.read.parquet(new), ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert path not in plan
    with pytest.raises(ValueError, match="whole panel"):
        model_store.train(wide, {"arima": model_store.arima_family()}, ["k"]).retrain(wide)
    refitted = model_store.train(wide.where("ts < '1970-01-01'"), {"arima": model_store.arima_family()}, ["k"]).retrain(wide, whole=wide)
    same(refitted.forecast(4), arima.arima_forecast(wide, ["k"], 4), ["step", "yhat"], ["yhat"])


def test_nothing_trained_gives_no_rows(spark, wide):
    trained = model_store.train(wide.where("false"), keys=["k"])
    assert trained.forecast(3).count() == 0 and trained.info().count() == 0
    with pytest.raises(ValueError, match="no families"):
        model_store.TrainedPanel([], {}, {}).forecast()


# ---- what a fit reports --------------------------------------------------------------


def test_residual_frames_and_statistics(spark, series, wide):
    rows = by_row(arima.arima_residuals(series, order=(1, 1, 0), seasonal=(0, 0, 0)), "ts")
    z = np.diff(Y)
    phi = (z[1:] * z[:-1]).sum() / (z[:-1] ** 2).sum()
    want = z - phi * np.concatenate([[0.0], z[:-1]])
    assert rows.resid.to_numpy() == pytest.approx(want, rel=1e-5, abs=1e-2) and str(rows.ts[0]) == str(month(1))
    assert (rows.y - rows.yhat).to_numpy() == pytest.approx(rows.resid.to_numpy(), abs=1e-6)
    got = metrics.fit_statistics(arima.arima_residuals(series, order=(1, 1, 0), seasonal=(0, 0, 0)), []).first()
    e = rows.resid.to_numpy()
    assert (got.n, got.mean_residual, got.std_residual) == pytest.approx((104, e.mean(), e.std()))
    assert got.r2 == pytest.approx(1 - (e**2).sum() / ((Y[1:] - Y[1:].mean()) ** 2).sum()) and got.mape == pytest.approx(np.abs(e / Y[1:]).mean() * 100)
    assert {r.k for r in arima.arima_residuals(wide, ["k"]).select("k").distinct().collect()} == {"a", None}
    tested = metrics.ljung_box(arima.arima_residuals(wide, ["k"]), ["k"]).collect()
    assert len(tested) == 2 and all(r.n == 92 and 0 <= r.lb_pvalue <= 1 for r in tested)


def test_errors_without_a_past_are_the_values():
    """After two equal months nothing is forecast, so the error is the difference itself, to the last bit."""
    values = np.array([0.0, 0.0, 0.0, 693563.5, 452348.67, 0.0, 0.0, 311020.5, 98765.43, 0.0, 0.0, 123456.5, 77.77, 5005.05])
    for more in range(40):
        own = values + np.where(values > 0, more, 0)
        errors = arima.fit_series(own, None, (1, 1, 0, 0, 0, 0), 12).errors
        assert [errors[i - 1] for i in (3, 7, 11)] == [own[i] for i in (3, 7, 11)]


def test_one_series_without_keys(spark, series):
    chosen = {n: f for n, f in model_store.families().items() if n in ("trend", "lag_regression")}
    first = model_store.train(series.where("ts < '1970-01-01'"), chosen)
    again = first.retrain(series.where("ts >= '1970-01-01'"))
    same(again.forecast(6), model_store.train(series, chosen).forecast(6), ["model", "step"], ["yhat"], 1e-7)
    assert {(r.model, r.n_rows) for r in again.info().collect()} == {("trend", 105), ("lag_regression", 93)}
