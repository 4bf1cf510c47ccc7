"""Results keep every row: tables as folders, test parts of any length, null keys, NaN, members that fail."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import month
from tidemill.operators import arima, clean, crossval, ensemble, lagreg, metrics
from tidemill.plans import forecasting
from tidemill.plans.catalog import QUERIES
from tidemill.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["stream_ingest", "stream_daily"])
def test_streams_read_folders_and_files_alike(spark, tmp_path, name):
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    one, parts = (QUERIES[name](spark, at).toPandas() for at in (SF, str(tmp_path)))
    assert len(one) > 0 and sorted(map(str, one.itertuples(index=False))) == sorted(map(str, parts.itertuples(index=False)))


def test_stream_without_a_table_fails_and_without_rows_lands_nothing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        jobs.open_table(spark, f"{tmp_path}/events.parquet", "x int")
    spark.read.parquet(f"{SF}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    for part in tmp_path.glob("events.parquet/*.parquet"):
        part.unlink()
    assert jobs.landed(spark, f"{tmp_path}/nothing", spark.range(1).schema).count() == 0


@pytest.fixture(scope="module")
def gappy(spark):
    """The same series under a null key and a named one."""
    rows = [(k, month(i), float(100 + 3 * i + 20 * math.sin(i))) for k in (None, "a") for i in range(72)]
    return spark.createDataFrame(rows, "k string, ts date, y double").cache()


def same_for_both(df, *columns):
    rows = {}
    for r in df.collect():
        rows.setdefault(r.k, []).append(tuple(r[c] for c in columns))
    assert set(rows) == {None, "a"} and sorted(rows[None]) == sorted(rows["a"])


def test_null_keys_are_forecast_like_others(gappy):
    same_for_both(lagreg.lag_regression_forecast(gappy, ["k"], 3, model=lagreg.LagRegression("ridge")), "step", "yhat")
    orders = gappy.select("k").distinct().selectExpr("k", "1 p", "1 d", "0 q", "0 sp", "0 sd", "0 sq")
    same_for_both(arima.arima_forecast(gappy, ["k"], 3, orders=orders), "step", "yhat", "status")
    same_for_both(crossval.cv_linear_trend(gappy, ["k"]), "fold", "y", "yhat")


def test_null_keys_keep_their_interval_and_pairs(gappy):
    pairs = gappy.withColumn("yhat", F.col("y") + F.month("ts"))
    same_for_both(metrics.residual_intervals(pairs, ["k"]), "y", "lower", "upper")
    same_for_both(clean.align_pairs(gappy, pairs.drop("y"), ["k"]), "y", "yhat")


def last_value(df, keys, horizon):
    last = df.groupBy(*keys).agg(F.max_by("y", "ts").alias("yhat"))
    blank = F.lit(None).cast("double")
    steps = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.select(*keys, "step", F.lit(None).cast("date").alias("ds"), "yhat", blank.alias("lower"), blank.alias("upper"))


def test_every_test_row_is_scored(gappy):
    scores = forecasting.holdout_scores(gappy, {"last": last_value}, ["k"])
    train, test = forecasting.split_parts(gappy, ["k"])
    n = test.groupBy("k").count().first()["count"]
    assert n > 12
    y = [r.y for r in gappy.where("k = 'a'").orderBy("ts").collect()]
    mae = sum(abs(v - y[-n - 1]) for v in y[-n:]) / n
    assert [r.mae for r in scores.collect()] == pytest.approx([mae, mae])
    with pytest.raises(ValueError, match="leaves out test rows"):
        forecasting.holdout_scores(gappy, {"last": last_value}, ["k"], n - 1)
    cut = forecasting.cross_validate_cutoffs(gappy, {"last": last_value}, ["k"], horizon=700)
    _, tests = crossval.cutoff_parts(gappy, ["k"], "ts", 730, 180, 700)
    assert cut.count() == tests.count() and tests.agg(F.max("step")).first()[0] > 13


def test_members_that_say_they_failed_have_no_score(gappy):
    def short(df, keys, horizon):
        return last_value(df, keys, horizon).withColumn("status", F.lit("short"))

    scores = {r.model: r for r in forecasting.holdout_scores(gappy, {"last": last_value, "short": short}, ["k"]).collect()}
    assert scores["short"].status == "failed" and scores["short"].mape is None and scores["last"].status == "success"
    fitted = forecasting.fit(gappy, {"last": last_value, "short": short}, ["k"], 4)
    assert {r.n_models for r in fitted.combined().collect()} == {1}
    assert {(r.model, r.weight) for r in fitted.weights.collect()} == {("last", 1.0), ("short", 0.0)}


def test_nan_is_no_value(spark):
    nan = float("nan")
    pairs = spark.createDataFrame([("m", 1, 10.0, 12.0), ("m", 2, 10.0, nan), ("m", 3, nan, 5.0), ("m", 4, 20.0, 20.0)], "model string, ts int, y double, yhat double")
    got = metrics.forecast_metrics(pairs, ["model"]).first()
    assert (got.n, got.mae, got.mape) == (2, 1.0, 10.0)
    parts = spark.createDataFrame([(m, 1, v, nan if m == "b" else 0.0, 9.0) for m, v in (("a", 4.0), ("b", 6.0), ("c", nan))], "model string, step int, yhat double, lower double, upper double").withColumn("ds", F.lit(None).cast("date"))
    assert ensemble.simple_average(parts).first().yhat == 5.0
    weights = ensemble.ensemble_weights(spark.createDataFrame([("a", 1.0), ("b", nan), ("c", 1.0)], "model string, mape double"))
    assert {r.model: r.weight for r in weights.collect()} == {"a": 0.5, "b": 0.0, "c": 0.5}
    got = ensemble.weighted_average(parts, weights, intervals=True).first()
    assert (got.n_models, got.yhat, got.lower, got.upper) == (1, 4.0, 0.0, 9.0)
    assert ensemble.ensemble_intervals(parts).first().n_models == 2


@pytest.mark.parametrize(("freq", "label"), [("D", "2024-01-01"), ("W", "2024-01-07"), ("M", "2024-01-31"), ("Q", "2024-03-31"), ("Y", "2024-12-31")])
def test_holidays_count_in_every_period(spark, freq, label):
    from tidemill.operators import calendar_effects

    days = spark.createDataFrame([("2024-01-01", "new year"), ("2024-01-01", "founding day"), ("2023-12-31", "eve")], "ds string, holiday string")
    rows = spark.createDataFrame([(label,)], "ts string").selectExpr("to_date(ts) AS ts")
    got = calendar_effects.holiday_regressors(rows, days, ["new year", "founding day", "eve"], freq=freq).first()
    assert (got["holiday_new year"], got["holiday_founding day"], got.holiday_eve) == (1.0, 1.0, 0.0)
    if freq == "D":
        assert calendar_effects.holiday_join(rows, days).first().holiday == "founding day, new year"
