"""Properties, edge cases and brute-force checks."""

from __future__ import annotations

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import CHAMPAGNE, month, one
from tidemill.functions.ordered import carry_fill
from tidemill.functions.quantiles import exact_quantiles
from tidemill.functions.student import t_quantile
from tidemill.operators import anomaly, clean, crossval, ensemble, features, isolation, metrics, profile, resample, scenario, trend
from tidemill.schema import RoleError, find_roles, require_roles, tidy_column_names

Y = np.array(CHAMPAGNE, dtype=float)


def frame(spark, values, start=(2000, 1), key=None):
    rows = [(month(i, start), None if v is None else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "ts date, y double")
    return df if key is None else df.withColumn("k", F.lit(key))


# ---- schema and cleaning -------------------------------------------------------------


def test_roles():
    assert find_roles(["id", "Order_Date", "Net_Revenue", "sales"]) == ("Order_Date", "Net_Revenue")
    assert find_roles(["a", "b"]) == (None, None)
    with pytest.raises(RoleError):
        require_roles(["sales_date"])
    with pytest.raises(RoleError):
        require_roles(["date", "x"])


def test_tidy_names(spark):
    df = spark.createDataFrame([(1, 2)], "`  Net Sales ($)` int, `Order-ID` int")
    assert tidy_column_names(df).columns == ["net_sales_", "orderid"]
    with pytest.raises(ValueError):
        tidy_column_names(spark.createDataFrame([(1, 2)], "`a b` int, a_b int"))


def test_clean_is_idempotent(raw):
    first = clean.clean(raw)
    again = clean.clean(first, ts="ts", y="y")
    assert sorted(first.collect()) == sorted(again.collect())


def test_clean_fills_before_it_keeps_the_last(spark):
    rows = [(1, "2020-01-01", None), (2, "2020-01-02", "5"), (3, "2020-01-02", "7"), (4, "2020-01-02", None),
            (5, "2020-01-03", "bad"), (6, "2020-01-04", None), (7, "2020-01-05", "9"), (8, "nonsense", "1")]
    df = spark.createDataFrame(rows, "seq int, date string, value string")
    for block in ("month", "day", None):
        got = {str(r.ts.date()): r.y for r in clean.clean(df, seq="seq", block=block).collect()}
        # leading gap takes the next present row; the row after bad text inherits the bad text and goes with it
        assert got == {"2020-01-01": 5.0, "2020-01-02": 7.0, "2020-01-05": 9.0}
    report = one(clean.clean_report(df, ts="date", y="value", seq="seq"))
    assert report.asDict() == {"rows_in": 8, "invalid_dates": 1, "missing_filled": 3, "duplicates_removed": 2,
                               "non_numeric_removed": 2, "rows_out": 3}


@pytest.mark.parametrize("block", ["year", "month", "day"])
def test_carry_fill_equals_pandas(spark, block):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(
        {"k": rng.integers(0, 2, 300), "ts": pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, 400, 300), "D"),
         "seq": range(300), "y": np.where(rng.random(300) < 0.6, np.nan, rng.normal(size=300))}
    )
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    got = carry_fill(df, ["k"], ["ts", "seq"], "y", block).toPandas().set_index("seq")["y"].sort_index()
    ordered = pdf.sort_values(["k", "ts", "seq"])
    expected = ordered.groupby("k")["y"].transform(lambda s: s.ffill().bfill())
    assert np.allclose(got, pd.Series(expected.to_numpy(), index=ordered["seq"]).sort_index())


def test_fills_keep_frames_that_grow(spark):
    """A frame from each row to the end is gone through again for every row: squared time in a dense block or a long series."""
    rows = [("a", dt.datetime(2020, 1 + i // 200, 1, 0, i % 60), i, None if i < 250 or i % 3 else float(i)) for i in range(600)]
    df = spark.createDataFrame([*rows, ("b", dt.datetime(2020, 1, 1), 0, None)], "k string, ts timestamp_ntz, seq int, y double")
    flagged = df.withColumn("is_outlier_consensus", F.col("y").isNull())
    frames = {
        "fill": clean.fill_missing(df, ["k"], "ts", "y", ["seq"]),
        "clean": clean.clean(df, ["k"], "ts", "y", "seq"),
        "clean without blocks": clean.clean(df, ["k"], "ts", "y", "seq", block=None),
        "interpolate": anomaly.interpolate_outliers(flagged, ["k"]),
        "isolation": isolation.isolation_scores(df, ["k"], ("ts", "seq"), trees=2),
    }
    for name, frame in frames.items():
        plan = frame._jdf.queryExecution().analyzed().toString().lower()
        assert not re.search(r"specifiedwindowframe\(\w+, (currentrow\$\(\)|1), unboundedfollowing", plan), name
    got = {(r.k, r.seq): r.y for r in frames["fill"].collect()}
    ordered = sorted((r[1:] for r in rows), key=lambda r: r[:2])
    first = next(y for _, _, y in ordered if y is not None)
    last, expected = None, {("b", 0): None}
    for _, seq, y in ordered:
        last = last if y is None else y
        expected["a", seq] = first if last is None else last
    assert got == expected


def test_interpolation_at_one_time(spark):
    """Rows of one time take the good point of that time, in whatever order they come."""
    rows = [(1, 1.0), (5, None), (5, 50.0), (5, None), (9, 9.0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(month(t), y, y is None) for t, y in order], "ts date, y double, is_outlier_consensus boolean")
        assert sorted(r.y for r in anomaly.interpolate_outliers(df).collect()) == [1.0, 9.0, 50.0, 50.0, 50.0]


def test_types_and_empty_rows(spark):
    df = spark.createDataFrame([("1.5", "2020-01-02", "TRUE"), ("", "x", "no"), ("abc", "", None)], "n string, d string, b string")
    got = clean.convert_types(df, {"n": "number", "d": "date", "b": "boolean", "gone": "number"}).collect()
    assert [r.n for r in got] == [1.5, None, None] and [r.b for r in got] == [True, False, False]
    assert got[0].d == dt.datetime(2020, 1, 2) and got[1].d is None
    with pytest.raises(ValueError):
        clean.convert_types(df, {"n": "money"})
    blank = spark.createDataFrame([("", None), (" ", None), ("a", None)], "a string, b string")
    assert clean.drop_empty_rows(blank).count() == 2 and clean.drop_empty_rows(blank, blank_is_empty=True).count() == 1


def test_steps_stop_at_the_first_failure(raw):
    steps = [("tidy", tidy_column_names), ("drop", clean.drop_empty_rows), ("fail", lambda d: d.select("missing")), ("never", lambda d: d)]
    out, results = clean.run_steps(raw, steps)
    assert [(r.name, r.success) for r in results] == [("tidy", True), ("drop", True), ("fail", False)]
    assert out.count() == 106 and results[0].rows == 107 and results[1].rows == 106 and results[2].rows is None


def test_trailing_range(series, panel):
    assert [clean.trailing_range(series, s).count() for s in ("6M", "1Y", "2Y", "All")] == [6, 12, 24, 105]
    assert clean.trailing_range(panel, "1Y", ["k"]).count() == 24


# ---- profiles ------------------------------------------------------------------------


@pytest.mark.parametrize("rule", ["linear", "floor"])
@pytest.mark.parametrize("n,accuracy", [(1, 100), (2, 100), (99, 100), (5000, 100), (5000, 10000)])
def test_exact_quantiles_equal_numpy(spark, n, accuracy, rule):
    rng = np.random.default_rng(n)
    values = np.round(rng.lognormal(0, 3, n), 1)
    heavy = np.where(rng.random(n) < 0.3, 7.0, values)  # one value holds a third of the rows
    df = spark.createDataFrame(pd.DataFrame({"k": rng.integers(0, 2, n), "v": heavy}))
    probs = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0) if rule == "linear" else (0.05, 0.25, 0.75)
    got = {r.k: list(r)[1:] for r in exact_quantiles(df, ["k"], "v", probs, rule, accuracy).collect()}
    for k, part in df.toPandas().groupby("k"):
        data = np.sort(part["v"].to_numpy())
        expected = np.quantile(data, probs) if rule == "linear" else [data[int(len(data) * p)] for p in probs]
        assert np.allclose(got[k], expected)


def test_exact_quantiles_without_keys_and_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("a", None)], "k string, v double")
    assert one(exact_quantiles(df, [], "v", [0.5])).q50 == 3.0
    assert {r.k: r.q50 for r in exact_quantiles(df, ["k"], "v", [0.5]).collect()} == {None: 2.0, "a": 5.0}


def test_validate_edge_inputs(spark):
    empty = spark.createDataFrame([], "date date, value double")
    got = one(profile.validate(empty))
    assert not got.is_valid and got.errors == ["table is empty"]
    no_roles = one(profile.validate(spark.createDataFrame([(1,)], "x int")))
    assert not no_roles.is_valid and len(no_roles.errors) == 2
    dup = spark.createDataFrame([("2020-01", 1.0), ("2020-01", 2.0), (None, 1.0), (None, None)], "month string, amount double")
    got = one(profile.validate(dup))
    assert (got.duplicate_dates, got.missing_dates, got.missing_values, len(got.warnings)) == (2, 2, 1, 3)


def test_frequency_codes(spark):
    def code(step, n=6):
        rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=step * i), 1.0) for i in range(n)]
        return one(profile.detect_frequency(spark.createDataFrame(rows, "ts date, y double"))).frequency

    assert [code(s) for s in (1, 7, 30, 91, 365)] == ["D", "W", "M", "Q", "Y"]
    assert one(profile.detect_frequency(frame(spark, [1.0]))).frequency == "M"
    # whole days only, as between timestamps hours apart; ties take the smaller gap
    hours = spark.createDataFrame([(dt.datetime(2020, 1, 1, h),) for h in (0, 5, 10)], "ts timestamp_ntz")
    assert one(profile.detect_frequency(hours)).frequency == "D"


def test_quality_report(spark):
    df = spark.createDataFrame([("1", None), ("1", None), ("", 4), ("x", 2)], "a string, b int")
    rows = {r.column_name: r for r in profile.quality_report(df).collect()}
    assert (rows["a"].missing, rows["b"].missing) == (1, 2) and rows["a"].duplicate_records == 1
    assert rows["a"].quality_score == pytest.approx(100 - 3 / 8 * 50) and rows["b"].max_value == 4


def test_importance_of_a_constant_feature_is_null(spark):
    df = frame(spark, range(10)).withColumn("flat", F.lit(3.0)).withColumn("twice", F.col("y") * -2)
    got = {r.feature: r.importance for r in profile.feature_importance(df).collect()}
    assert got["flat"] is None and got["twice"] == pytest.approx(1.0)
    assert [r.feature for r in profile.top_k_features(df, k=1).collect()] == ["twice"]
    assert profile.correlation_report(df).where("feature = 'twice'").first().strength == "strong"


# ---- resampling ----------------------------------------------------------------------


@pytest.mark.parametrize("freq", ["D", "W", "M", "Q", "Y"])
def test_resample_equals_pandas_and_keeps_the_total(spark, freq):
    rng = np.random.default_rng(5)
    days = pd.to_datetime("2019-11-20") + pd.to_timedelta(np.sort(rng.choice(900, 60, replace=False)), "D")
    pdf = pd.DataFrame({"ts": days, "y": np.round(rng.random(60) * 100, 2)})
    got = resample.resample(spark.createDataFrame(pdf), freq=freq, digits=2).toPandas().sort_values("ts")
    code = {"D": "D", "W": "W", "M": "ME", "Q": "QE", "Y": "YE"}[freq]
    expected = pdf.set_index("ts")["y"].resample(code).sum()
    assert list(pd.to_datetime(got["ts"])) == list(expected.index)
    assert np.allclose(got["y"], expected) and np.isclose(got["y"].sum(), pdf["y"].sum())


def test_unknown_frequency(series):
    with pytest.raises(ValueError):
        resample.resample(series, freq="H")


def test_open_period_is_dropped(spark):
    raw = spark.createDataFrame([(dt.date(2020, 1, 5), 1.0), (dt.date(2020, 2, 29), 2.0), (dt.date(2020, 3, 1), 4.0)], "ts date, y double")
    sums = resample.resample(raw)
    assert [r.y for r in resample.closed_periods(sums, raw, "ts").orderBy("ts").collect()] == [1.0, 2.0]
    full = raw.where("y < 4")
    assert resample.closed_periods(resample.resample(full), full, "ts").count() == 2


# ---- features --------------------------------------------------------------------------


def test_features_equal_pandas(series):
    got = features.all_features(series).toPandas().sort_values("ts").reset_index(drop=True)
    s = pd.Series(Y)
    assert len(got) == 93 and len(got.columns) == 2 + 39
    check = {
        "y_lag_12": s.shift(12), "y_rolling_mean_6": s.rolling(6).mean(), "y_rolling_std_12": s.rolling(12).std(),
        "y_rolling_min_3": s.rolling(3).min(), "growth_rate": s.pct_change(), "acceleration": s.pct_change().diff(),
        "y_percentile": s.rank(pct=True), "y_zscore": (s - s.mean()) / s.std(ddof=0), "cv": s.rolling(12).std() / s.rolling(12).mean(),
        "distance_from_mean": (s - s.mean()).abs(), "linear_trend": pd.Series(range(105)),
    }
    for name, expected in check.items():
        assert np.allclose(got[name].astype(float), expected[12:]), name


def test_model_features_have_43_columns_and_lagged_ones_do_not_see_the_target(series):
    plain = features.model_features(series)
    assert len(plain.columns) == 2 + 43
    base = features.model_features(series, lagged=True).orderBy("ts").collect()[-1]
    changed = series.withColumn("y", F.when(F.col("ts") == "1972-09-01", 1e9).otherwise(F.col("y")))
    other = features.model_features(changed, lagged=True).orderBy("ts").collect()[-1]
    assert {k: v for k, v in base.asDict().items() if k != "y"} == {k: v for k, v in other.asDict().items() if k != "y"}


def test_lookback_sequences(series, panel):
    rows = features.lookback_sequences(series).orderBy("ts").collect()
    assert len(rows) == 93 and rows[0].window == list(Y[:12]) and rows[0].target == Y[12]
    wide = features.lookback_sequences(series.withColumn("z", F.lit(1.0)), columns=["y", "z"]).orderBy("ts").first()
    assert wide.window[0].y == Y[0] and wide.window[0].z == 1.0
    assert features.lookback_sequences(panel, ["k"]).count() == (105 - 12) + (81 - 12)


def test_scaling(panel):
    df = panel.withColumn("flat", F.lit(5.0)).withColumn("x", F.col("y") * 2)
    got = features.scale_features(df, "standard", "y", ["k"]).groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.max("flat").alias("f"))
    for r in got.collect():
        assert (r.m, r.s, r.f) == (pytest.approx(0, abs=1e-9), pytest.approx(1), 0.0)
    lo_hi = features.scale_features(df, "minmax", "y", ["k"]).agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
    assert (lo_hi.a, lo_hi.b) == (0.0, 1.0)
    scaler = features.fit_scaler(df.where("k = 'a'"), ["x"])
    reused = features.scale_features(df.where("k = 'b'"), scaler=scaler)
    assert reused.agg(F.avg("x").alias("m")).first().m > 1
    with pytest.raises(ValueError):
        features.scale_features(df, "robust")


def test_interactions(spark):
    df = spark.createDataFrame([(2.0, 3.0, 5.0)], "a double, b double, c double")
    got = features.interaction_features(df, ["a", "b", "c"], 3).first().asDict()
    assert (got["a b"], got["a c"], got["b c"], got["a b c"]) == (6.0, 10.0, 15.0, 30.0) and len(got) == 7


# ---- anomalies -------------------------------------------------------------------------


def test_constant_and_short_series_never_flag(spark):
    for values in ([5.0] * 30, [5.0], [None, None, None]):
        got = anomaly.consensus_outliers(frame(spark, values), isolation=False)
        assert got.where("is_outlier_consensus").count() == 0 and got.count() == len(values)
        assert got.where("is_outlier_iqr is null or is_outlier_zscore is null or is_outlier_seasonal is null").count() == 0


def test_mad_zero_gives_no_score(spark):
    got = anomaly.modified_zscore_outliers(frame(spark, [1, 1, 1, 1, 50])).collect()
    assert all(r.outlier_score_modified_zscore is None and not r.is_outlier_modified_zscore for r in got)


def test_scales_agree(panel):
    for detect in (anomaly.iqr_outliers, anomaly.zscore_outliers, anomaly.modified_zscore_outliers):
        a = sorted(map(tuple, detect(panel, ["k"], scale="series").collect()))
        b = sorted(map(tuple, detect(panel, ["k"], scale="rows").collect()))
        assert [r[:4] for r in a] == [r[:4] for r in b]
        assert np.allclose([r[4] for r in a], [r[4] for r in b])


def test_rolling_detector_can_fire_from_seven_rows(spark):
    values = [10, 11, 10, 11, 10, 11, 10, 90, 10, 11, 10, 11, 10, 11]
    assert anomaly.rolling_outliers(frame(spark, values)).where("is_outlier_rolling").count() == 0
    wide = anomaly.rolling_outliers(frame(spark, values), window=7).where("is_outlier_rolling").collect()
    assert [r.y for r in wide] == [90.0]


@pytest.mark.parametrize("scale", ["series", "rows"])
def test_isolation_forest(spark, scale):
    rng = np.random.default_rng(1)
    values = rng.normal(100, 5, 200)
    values[[20, 150]] = [400, -300]
    df = frame(spark, values, start=(1900, 1))
    first = anomaly.isolation_outliers(df, scale=scale)
    again = anomaly.isolation_outliers(df.repartition(7), scale=scale)
    rows = {r.ts: r for r in first.collect()}
    assert {r.ts: r.outlier_score_isolation for r in again.collect()} == {t: r.outlier_score_isolation for t, r in rows.items()}
    top = sorted(rows.values(), key=lambda r: -r.outlier_score_isolation)[:2]
    assert {r.y for r in top} == {400.0, -300.0}
    assert sum(r.is_outlier_isolation for r in rows.values()) == pytest.approx(20, abs=2)
    assert all(0 < r.outlier_score_isolation < 1 for r in rows.values())


def test_consensus_summary_and_points(panel):
    out = anomaly.consensus_outliers(panel, ["k"]).cache()
    names = {r.method for r in anomaly.outlier_summary(out, ["k"]).collect()}
    assert names == {"iqr", "zscore", "isolation", "seasonal", "rolling", "consensus"}
    votes = anomaly.vote_histogram(out, ["k"]).agg(F.sum("n").alias("n")).first().n
    assert votes == out.count()
    for method in ("comprehensive", "isolation_forest", "statistical", "seasonal"):
        pts = anomaly.anomaly_points(panel, method, "low", ["k"])
        assert pts.count() == panel.count() and pts.columns[-2:] == ["is_anomaly", "anomaly_score"]
    assert anomaly.anomaly_points(panel, "statistical", "high", ["k"]).where("is_anomaly").count() > 0
    with pytest.raises(ValueError):
        anomaly.anomaly_points(panel, "magic")
    got = anomaly.detect(panel, ["iqr", "zscore"], ["k"])
    assert {"is_outlier_iqr", "is_outlier_zscore"} <= set(got.columns)


def test_treatments(spark):
    values = [10, 20, 1000, 40, 50, 2000]
    df = frame(spark, values).withColumn("is_outlier_consensus", F.col("y") > 500).withColumn("rolling_zscore", F.lit(0.0))
    assert anomaly.treat_outliers(df, "remove").count() == 4
    got = anomaly.treat_outliers(df, "interpolate").orderBy("ts")
    days = [0, 31, 60, 91]
    assert got.columns == ["ts", "y"]
    rows = [r.y for r in got.collect()]
    assert rows[2] == pytest.approx(20 + 20 * (days[2] - days[1]) / (days[3] - days[1])) and rows[5] == 50.0
    lead = anomaly.treat_outliers(frame(spark, [999, 1, 2]).withColumn("is_outlier_consensus", F.col("y") > 500)).orderBy("ts")
    assert [r.y for r in lead.collect()] == [None, 1.0, 2.0]
    assert anomaly.treat_outliers(frame(spark, [1, 2])).count() == 2


def test_patterns_cover_month_year_and_all(panel):
    out = anomaly.iqr_outliers(panel, ["k"])
    rows = anomaly.anomaly_patterns(out, "is_outlier_iqr", ["k"]).collect()
    for k in ("a", "b"):
        total = next(r.n for r in rows if r.k == k and r.level == "all")
        assert total == sum(r.n for r in rows if r.k == k and r.level == "month") == sum(r.n for r in rows if r.k == k and r.level == "year")


# ---- trend, scenario ---------------------------------------------------------------------


@pytest.mark.parametrize("model", ["additive", "multiplicative"])
def test_decomposition_adds_back(panel, model):
    rows = trend.decompose(panel, ["k"], model=model).where("trend is not null").collect()
    assert len(rows) == 105 - 12 + 81 - 12
    for r in rows:
        back = r.trend + r.seasonal + r.residual if model == "additive" else r.trend * r.seasonal * r.residual
        assert back == pytest.approx(r.observed)
    short = trend.decompose(panel.limit(20), ["k"]).where("trend is not null").count()
    assert short == 0


def test_odd_period_decomposition(series):
    got = trend.decompose(series, period=3).orderBy("ts").collect()
    assert got[0].trend is None and got[1].trend == pytest.approx(Y[:3].mean())


def test_kpis_on_short_series(spark):
    twelve, thirteen = one(trend.kpis(frame(spark, range(1, 13)))), one(trend.kpis(frame(spark, range(1, 14))))
    assert twelve.yoy_growth is None and thirteen.yoy_growth == pytest.approx(1200.0)
    single = one(trend.kpis(frame(spark, [5.0])))
    assert (single.current_value, single.previous_value, single.mom_growth, single.trend_direction) == (5, 5, 0, "stable")


def test_operators_accept_a_single_row(spark):
    df = frame(spark, [5.0])
    assert trend.linear_trend(df).first().slope is None
    assert one(trend.growth_rates(df.union(frame(spark, [6.0], (2000, 2))))).n_growth == 1
    assert one(profile.distribution_stats(df)).skewness is None
    assert profile.yearly_growth(df).count() == 0
    assert scenario.base_path(df).count() == 12
    assert features.all_features(df).count() == 0


def test_scenarios(series):
    path = scenario.base_path(series).cache()
    grown = scenario.scenario(path, "growth_rate", percent=12.0).orderBy("step").collect()
    assert grown[11].scenario == pytest.approx(grown[11].base * 1.12) and grown[0].scenario == pytest.approx(grown[0].base * 1.01)
    boosted = scenario.scenario(path, "seasonal_adjustment", percent=50.0).collect()
    assert {r.ds.month for r in boosted if abs(r.scenario - r.base) > 1e-9} == {11, 12}
    flat = scenario.scenario(path, "trend_change", slope=10.0).orderBy("step").collect()
    assert [r.scenario for r in flat[:2]] == [5887.0, 5897.0]
    impact = one(scenario.scenario_impact(scenario.scenario(path, "seasonal_adjustment", percent=0.0)))
    assert (impact.percentage_impact, impact.recommendation) == (0.0, "Neutral impact")
    with pytest.raises(ValueError):
        scenario.scenario(path, "magic")


def test_trend_analysis_parts(panel):
    assert set(trend.trend_analysis(panel, "comprehensive", ["k"])) == {
        "linear_trend", "growth_rates", "monthly_pattern", "quarterly_pattern", "seasonality", "yearly_growth"
    }
    assert set(trend.trend_analysis(panel, "seasonal", ["k"])) == {"monthly_pattern", "quarterly_pattern", "seasonality"}


# ---- metrics, cross-validation, ensembles ---------------------------------------------------


def pairs_frame(spark, y, p, model="m"):
    rows = [(model, month(i), None if a is None else float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "model string, ts date, y double, yhat double")


def test_metrics_equal_numpy(spark):
    rng = np.random.default_rng(2)
    y, p = rng.normal(100, 20, 40), rng.normal(100, 20, 40)
    got = one(metrics.evaluation_report(pairs_frame(spark, y, p), ["model"]))
    e = y - p
    assert got.mae == pytest.approx(np.abs(e).mean()) and got.rmse == pytest.approx(np.sqrt((e**2).mean()))
    assert got.r2 == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())
    assert got.mape == pytest.approx(np.abs(e / y).mean() * 100) and got.me == pytest.approx(-e.mean())
    assert got.smape == pytest.approx((2 * np.abs(e) / (np.abs(y) + np.abs(p))).mean() * 100)
    assert got.directional_accuracy == pytest.approx((np.sign(np.diff(y)) == np.sign(np.diff(p))).mean() * 100)
    assert got.trend_accuracy == pytest.approx(max(0, np.corrcoef(np.diff(y), np.diff(p))[0, 1]) * 100)
    assert got.residual_autocorr == pytest.approx(np.corrcoef(e[:-1], e[1:])[0, 1]) and got.std_residual == pytest.approx(e.std())


def test_metrics_with_zero_actuals_and_nulls(spark):
    got = one(metrics.forecast_metrics(pairs_frame(spark, [0, 10, None], [5, 20, 1]), ["model"]))
    assert (got.n, got.n_zero_actual, got.mape, got.mae) == (2, 1, 100.0, 7.5)
    all_zero = one(metrics.forecast_metrics(pairs_frame(spark, [0, 0], [0, 0]), ["model"]))
    assert (all_zero.mape, all_zero.smape, all_zero.mpe, all_zero.r2) == (100.0, 100.0, 0.0, None)


def test_grades(spark):
    y = np.arange(1, 25) * 10.0
    got = one(metrics.evaluation_report(pairs_frame(spark, y, y * 1.01), ["model"]))
    assert got.performance_level == "Excellent" and "Low prediction error" in got.key_strengths and not got.areas_for_improvement
    bad = one(metrics.evaluation_report(pairs_frame(spark, y, y[::-1]), ["model"]))
    assert bad.performance_level == "Poor" and "High prediction error" in bad.areas_for_improvement


def test_t_quantiles_and_intervals(spark):
    # published values of the 97.5 % quantile
    for dof, value in ((1, 12.706), (2, 4.303), (5, 2.571), (10, 2.228), (30, 2.042), (104, 1.983)):
        assert t_quantile(0.975, dof) == pytest.approx(value, abs=6e-4)
    y, p = [1.0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11], [1.5, 2, 2.5, 4, 5.5, 6, 6.5, 8, 9.5, 10, 10.5]
    got = metrics.residual_intervals(pairs_frame(spark, y, p), ["model"]).first()
    assert got.margin == pytest.approx(2.228139 * np.std(np.array(y) - np.array(p)), rel=1e-5)
    single = metrics.residual_intervals(pairs_frame(spark, [5.0], [10.0]), ["model"]).first()
    assert (single.lower, single.upper) == (9.0, 11.0)


def test_ljung_box_against_the_formula(spark):
    rng = np.random.default_rng(4)
    e = rng.normal(size=80)
    df = spark.createDataFrame([("m", month(i), float(v)) for i, v in enumerate(e)], "model string, ts date, resid double")
    got = one(metrics.ljung_box(df, ["model"]))
    d = e - e.mean()
    rho = np.array([(d[k:] * d[:-k]).sum() / (d**2).sum() for k in range(1, 11)])
    assert got.lb_stat == pytest.approx(80 * 82 * (rho**2 / (80 - np.arange(1, 11))).sum()) and got.is_white_noise
    wave = spark.createDataFrame([("m", month(i), float(np.sin(i))) for i in range(80)], "model string, ts date, resid double")
    assert not one(metrics.ljung_box(wave, ["model"])).is_white_noise


def test_ranking_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("b", 1.0, 1.0, 1.0), ("a", 1.0, 2.0, 1.0)], "model string, mae double, rmse double, mape double")
    ranks = {(r.metric, r.model): r["rank"] for r in metrics.model_ranking(df).collect()}
    assert ranks[("mae", "a")] == 1 and ranks[("rmse", "b")] == 1
    assert one(metrics.model_best(df)).best_model == "a"


def test_folds_equal_brute_force(series, panel):
    got = sorted((r.fold, r.idx) for r in crossval.fold_tests(series, horizon=6, step=3).collect())
    expected = [(f, i) for f, cut in enumerate(range(52, 105 - 6 + 1, 3)) for i in range(cut, cut + 6)]
    assert got == expected
    assert [r.cut for r in crossval.fold_cuts(series, horizon=6, step=3).orderBy("fold").collect()] == list(range(52, 100, 3))
    gaps = sorted((r.fold, r.idx) for r in crossval.fold_tests(series, initial=90, horizon=2, step=5).collect())
    assert gaps == [(0, 90), (0, 91), (1, 95), (1, 96), (2, 100), (2, 101)]
    assert crossval.fold_tests(series.limit(3), initial=10, horizon=2).count() == 0


def test_cv_linear_trend_equals_polyfit(series):
    rows = crossval.cv_linear_trend(series).where("fold = 2").orderBy("ts").collect()
    slope, intercept = np.polyfit(np.arange(58), Y[:58], 1)
    assert [r.yhat for r in rows] == pytest.approx(list(intercept + slope * np.arange(58, 64)))
    scores = one(crossval.cv_scores(crossval.cv_linear_trend(series)))
    assert scores.n_folds == 16 and scores.avg_mae > 0


def test_cutoffs(series):
    got = [r.cutoff for r in crossval.cv_cutoffs(series).orderBy("cutoff").collect()]
    last = dt.date(1972, 9, 1) - dt.timedelta(days=365)
    assert got[-1] == last and got[0] >= dt.date(1964, 1, 1) + dt.timedelta(days=730)
    assert all((b - a).days == 180 for a, b in zip(got, got[1:]))


def test_ensembles(spark):
    rows = [("a", 1, 10.0), ("b", 1, 20.0), ("a", 2, 30.0), ("b", 2, 50.0), ("a", 3, 1.0)]
    fc = spark.createDataFrame(rows, "model string, step int, yhat double").withColumn("ds", F.lit("2020-01-31").cast("date"))
    fc = fc.withColumns({"lower": F.col("yhat") - 1, "upper": F.col("yhat") + 1})
    simple = {r.step: r.yhat for r in ensemble.simple_average(fc).collect()}
    assert simple == {1: 15.0, 2: 40.0}  # step 3 is not reached by every member
    scores = spark.createDataFrame([("a", 9.0, "success"), ("b", None, "failed"), ("c", 0.0, "success")], "model string, mape double, status string")
    w = {r.model: r.weight for r in ensemble.ensemble_weights(scores).collect()}
    assert w == {"a": pytest.approx(0.1 / 1.1), "b": 0.0, "c": pytest.approx(1 / 1.1)}
    given = ensemble.ensemble_weights(scores, given={"a": 3.0, "b": 1.0})
    got = {r.step: (r.yhat, r.lower, r.upper) for r in ensemble.weighted_average(fc, given, intervals=True).collect()}
    assert got[1] == (pytest.approx(12.5), pytest.approx(11.5), pytest.approx(13.5))
    bare = ensemble.weighted_average(fc.withColumn("lower", F.lit(None).cast("double")), given, intervals=True).where("step = 1").first()
    assert bare.upper == pytest.approx(15 + 1.96 * 5)
    failed = scores.withColumn("status", F.lit("failed"))
    assert [r.weight for r in ensemble.ensemble_weights(failed).collect()] == pytest.approx([1 / 3] * 3)
    assert ensemble.contributions(scores, ensemble.ensemble_weights(scores)).where("weight_rank = 1").first().model == "c"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(mapes=st.lists(st.floats(0, 1000), min_size=1, max_size=6))
def test_weights_sum_to_one(spark, mapes):
    df = spark.createDataFrame([(f"m{i}", float(m)) for i, m in enumerate(mapes)], "model string, mape double")
    rows = ensemble.ensemble_weights(df).collect()
    assert sum(r.weight for r in rows) == pytest.approx(1.0) and all(r.weight >= 0 for r in rows)
