"""Known numbers on the 105-month champagne series."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import one
from tidemill.operators import anomaly, clean, profile, resample, scenario, trend

approx = lambda v: pytest.approx(v, rel=1e-6)


def test_clean(raw):
    out = clean.clean(raw)
    facts = one(out.agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")))
    assert (facts.n, facts.lo, facts.hi) == (105, dt.datetime(1964, 1, 1), dt.datetime(1972, 9, 1))
    report = one(clean.clean_report(raw))
    assert (report.rows_in, report.invalid_dates, report.rows_out) == (107, 2, 105)
    assert (report.missing_filled, report.duplicates_removed, report.non_numeric_removed) == (0, 0, 0)


def test_validate_survives_text_dates_with_nulls(raw):
    got = one(profile.validate(raw))
    assert got.is_valid and got.missing_dates == 1 and got.missing_values == 2 and got.total_records == 107


@pytest.mark.parametrize("scale", ["rows", "series"])
def test_summary(series, scale):
    got = one(profile.distribution_stats(series, scale=scale))
    assert got["mean"] == approx(4761.152380952381) and got["std"] == approx(2553.502601183144)
    assert (got["min"], got["max"], got["median"], got["q25"], got["q75"]) == (1413, 13916, 4217, 3113, 5221)
    assert got["skewness"] == approx(1.639003039912007) and got["kurtosis"] == approx(2.7028889288455717)
    assert got["variance"] == approx(6520375.534249084)
    assert got["frequency"] == "M" and got["missing_values"] == 0


def test_growth(series):
    yoy = one(profile.yoy_growth(series))
    assert yoy.n_growth == 93 and yoy.mean_yoy_growth == approx(0.0739196759965355)
    assert yoy.std_yoy_growth == approx(0.18513068095507823) and yoy.latest_yoy_growth == approx(-0.01243488489329525)
    rates = one(trend.growth_rates(series))
    assert rates.mean_growth == approx(0.15012104359459583) and rates.std_growth == approx(0.6421369533246819)
    assert rates.recent_3 == approx(0.7657015587431754) and rates.recent_12 == approx(0.23128599692869714)


def test_seasons(series):
    means = {r.month: r["mean"] for r in profile.seasonal_profile(series).collect()}
    expected = [3601.5556, 3235, 3827.5556, 3958.3333, 4149.8889, 4265.8889, 3652.1111, 1726.7778, 4678.1111, 5826.625, 8610.5, 10820.875]
    assert [means[m] for m in range(1, 13)] == pytest.approx(expected, abs=1e-4)
    got = one(profile.seasonality_strength(series))
    assert (got.peak_month, got.trough_month) == (12, 8) and got.seasonality_strength == approx(0.5143055317906684)


def test_frequency_is_31_days_monthly(series):
    got = one(profile.detect_frequency(series))
    assert (got.modal_days, got.frequency) == (31, "M")


def test_quarters_and_future_labels(series):
    got = resample.resample(series, freq="Q").orderBy("ts").limit(3).collect()
    assert [(str(r.ts), r.y) for r in got] == [("1964-03-31", 8242), ("1964-06-30", 8703), ("1964-09-30", 7416)]
    ahead = resample.future_calendar(series, 3).orderBy("step").collect()
    assert [str(r.ds) for r in ahead] == ["1972-10-31", "1972-11-30", "1972-12-31"]


def test_linear_trend(series):
    got = trend.linear_trend(series).first()
    assert got.slope == approx(22.48814016) and got.intercept == approx(3591.76909254)


def test_decomposition(series):
    rows = trend.decompose(series).orderBy("ts").collect()
    known = [r.trend for r in rows if r.trend is not None]
    assert len(known) == 93 and (known[0], known[-1]) == (approx(3466.75), approx(5694.5))
    expected = [-1223.4116, -1624.2501, -979.2293, -850.2449, -652.0961, -671.1735, -1242.5001, -3060.5053, -312.3907, 965.729, 3730.1301, 5919.9426]
    assert [r.seasonal for r in rows[:12]] == pytest.approx(expected, abs=1e-4)


def test_kpis(series):
    got = one(trend.kpis(series))
    assert (got.current_value, got.previous_value) == (5877, 1413)
    assert got.mom_growth == approx(315.9235668789809) and got.yoy_growth == approx(-1.2434884893295246)
    assert got.recent_slope == approx(-148.1142857142858) and got.trend_direction == "decreasing"
    assert got.volatility == approx(53.632028485346716) and got.volatility_level == "high"


def test_scenario_base(series):
    path = scenario.base_path(series)
    assert path.first().slope == approx(-484.25524475524423)
    assert one(path.agg(F.sum("base").alias("t"))).t == approx(32461.5377622378)


def test_outlier_counts(series):
    count = lambda df, c: df.where(F.col(c)).count()
    assert count(anomaly.iqr_outliers(series), "is_outlier_iqr") == 10
    assert count(anomaly.zscore_outliers(series, threshold=2.5), "is_outlier_zscore") == 4
    assert count(anomaly.zscore_outliers(series, threshold=1.5), "is_outlier_zscore") == 10
    assert count(anomaly.modified_zscore_outliers(series, threshold=3.5), "is_outlier_modified_zscore") == 9
    seasonal = anomaly.seasonal_outliers(series)
    assert count(seasonal, "is_outlier_seasonal") == 0
    assert one(seasonal.agg(F.max("seasonal_zscore").alias("m"))).m == approx(2.228659645064784)
    rolling = anomaly.rolling_outliers(series)
    assert count(rolling, "is_outlier_rolling") == 0
    assert one(rolling.agg(F.max("rolling_zscore").alias("m"))).m == approx(1.6688653916670657)


@pytest.mark.parametrize("scale", ["rows", "series"])
def test_winsorize_limits(series, scale):
    got = one(anomaly.winsorize(series, scale=scale).agg(F.min("y").alias("lo"), F.max("y").alias("hi")))
    assert got.lo == approx(1742.2) and got.hi == approx(10492.4)
