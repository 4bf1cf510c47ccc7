"""Streams with state against the batch operators: cleaning and KPIs, with rows out of order."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators import clean, resample, trend
from tidemill.streaming import jobs, stateful
from tidemill.streaming.stateful import OpenPeriods, OpenTimes

START = dt.datetime(2024, 1, 1)


def arrive(spark, source, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)


# ---- the states by themselves --------------------------------------------------------


def batch_fill(rows):
    """The rules of the batch operator on (time, seq, value)."""
    times = {}
    for t, seq, v in rows:
        times.setdefault(t, [])
        if v is not None:
            times[t].append((seq, v))
    known, out = None, {}
    for t in sorted(times):
        if times[t]:
            if known is None:
                out |= {early: min(times[t])[1] for early in times if early < t}
            known = max(times[t])[1]
        if known is not None:
            out[t] = known
    return out


@pytest.mark.parametrize("seed", range(12))
def test_open_times_end_as_a_batch(seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(30), seq, rng.choice([None, None, "1", "2", "x"])) for seq in range(60)]
    rows.sort(key=lambda r: r[0] + rng.random() * 5)  # out of order by at most five
    saved, shown, newest = None, {}, -10
    while rows:
        n = rng.randint(1, 9)
        batch, rows = rows[:n], rows[n:]
        held = OpenTimes(saved)
        if newest - 6 > 0:
            held.close(newest - 6)
        assert all(held.add(*r) for r in batch)
        shown |= dict(held.changes())
        newest = max(newest, *(t for t, _, _ in batch))
        saved = held.saved()
        assert len(held.open) <= 30
    rng = random.Random(seed)
    every = [(rng.randrange(30), seq, rng.choice([None, None, "1", "2", "x"])) for seq in range(60)]
    assert shown == batch_fill(every)


def test_rows_after_closing_are_refused():
    held = OpenTimes(None)
    assert held.add(5, 1, None) and held.changes() == []
    held.close(10)
    assert not held.add(7, 2, "3") and held.add(11, 3, "4")
    assert held.changes() == [(5, "4"), (11, "4")]  # the early time waited for its first value
    held.close(20)
    again = OpenTimes(held.saved())
    assert again.add(21, 4, None) and again.changes() == [(21, "4")] and not again.open.get(11)


def test_open_periods_keep_kpis():
    held = OpenPeriods(None)
    for period, value in ((3, 2.0), (3, 3.0), (6, 7.0)):
        held.add(period, value)
    assert held.close(6) and not held.close(6)  # 3, and the empty 4 and 5 before a period with rows
    held = OpenPeriods(held.saved())
    assert held.n == 3 and held.last == [5.0, 0.0, 0.0] and held.waits_for() == 6
    held.add(5, 1.0)
    assert held.late == 1 and held.close(7) and held.facts("D")[0] == 4 and held.waits_for() is None


# ---- cleaning ------------------------------------------------------------------------


def test_clean_stream_equals_batch_clean(spark, tmp_path):
    rng = random.Random(2)
    schema = "k string, date string, sales string, seq long"
    rows = []
    for seq in range(400):
        day = START + dt.timedelta(days=rng.randrange(60))
        date = "unknown" if rng.random() < 0.05 else day.strftime("%Y-%m-%d")
        rows.append((rng.choice(["a", "a", "a", "b", None]), date, rng.choice([None, "1", "2.5", "lots", str(seq)]), seq))
    rows.sort(key=lambda r: (r[1], rng.random()))
    rows = sorted(rows, key=lambda r: (START if r[1] == "unknown" else dt.datetime.fromisoformat(r[1])) + dt.timedelta(days=rng.random() * 8))
    source, out, progress = (str(tmp_path / x) for x in ("src", "out", "cp"))
    key = [T.StructField("k", T.StringType())]

    def run():
        stream = jobs.open_folder(spark, source, schema, "parquet", files_per_batch=1)
        stateful.clean_stream(stream, out, progress, "seq", ["k"], late="10 days").awaitTermination()

    for i in range(0, 400, 100):
        arrive(spark, source, rows[i : i + 100], schema)
        run()
    run()  # nothing new
    got = {(r.k, str(r.ts)[:10]): r.y for r in stateful.cleaned(spark, out, key).collect()}
    want = {(r.k, str(r.ts)[:10]): r.y for r in clean.clean(spark.createDataFrame(rows, schema), ["k"], "date", "sales", "seq").collect()}
    assert got == want and len(got) > 100
    assert stateful.late_rows(spark, out, key).count() == 0
    arrive(spark, source, [("a", "2024-01-02", "77", 999), ("a", "2024-01-03", None, 998)], schema)
    run()
    assert {(r.k, r.n_late) for r in stateful.late_rows(spark, out, key).collect()} == {("a", 2)}
    assert {(r.k, str(r.ts)[:10]): r.y for r in stateful.cleaned(spark, out, key).collect()} == want


def test_clean_stream_of_nothing_and_without_keys(spark, tmp_path):
    source, out, progress = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = "date string, sales string, seq long"
    assert stateful.cleaned(spark, out).count() == 0
    arrive(spark, source, [], schema)
    arrive(spark, source, [("2024-01-02", None, 1), ("2024-01-03", "4", 2), (None, "9", 3)], schema)
    stateful.clean_stream(jobs.open_folder(spark, source, schema, "parquet"), out, progress, "seq").awaitTermination()
    assert [(str(r.ts), r.y) for r in stateful.cleaned(spark, out).orderBy("ts").collect()] == [("2024-01-02 00:00:00", 4.0), ("2024-01-03 00:00:00", 4.0)]


# ---- KPIs ----------------------------------------------------------------------------


@pytest.mark.parametrize("freq", ["M", "W", "D"])
def test_kpi_stream_equals_batch_kpis(spark, tmp_path, freq):
    rng = random.Random(5)
    schema = "k string, ts timestamp_ntz, y double"
    span = {"M": 700, "W": 200, "D": 40}[freq]
    rows = []
    for _ in range(500):
        k = rng.choice(["a", "a", "b", None])
        day = rng.randrange(span if k != "b" else span // 2)  # "b" ends early and closes without new rows
        if k == "a" and 0.4 < day / span < 0.6:
            continue  # a gap of several periods
        rows.append((k, START + dt.timedelta(days=day, hours=rng.randrange(24)), rng.choice([None, float(rng.randint(1, 90))])))
    rows.sort(key=lambda r: r[1] + dt.timedelta(days=rng.random() * 2))
    source, out, progress = (str(tmp_path / x) for x in ("src", "out", "cp"))
    n = len(rows)
    for i in range(3):
        arrive(spark, source, rows[i * n // 3 : (i + 1) * n // 3], schema)
        stateful.kpi_stream(jobs.open_folder(spark, source, schema, "parquet"), out, progress, ["k"], freq=freq, late="3 days").awaitTermination()
    df = spark.createDataFrame(rows, schema)
    watermark = max(r[1] for r in rows) - dt.timedelta(days=3)
    panel = resample.resample(df, ["k"], "ts", "y", freq).where(F.date_add("ts", 1) <= F.lit(watermark.date()))
    want = {r.k: r for r in trend.kpis(panel, ["k"]).collect()}
    got = {r.k: r for r in stateful.kpis_now(spark, out, [T.StructField("k", T.StringType())]).collect()}
    assert got.keys() == want.keys() == {"a", "b", None}
    for k, r in want.items():
        for c in want[k].asDict():
            a, b = got[k][c], r[c]
            assert a == (pytest.approx(b, rel=1e-9) if isinstance(b, float) else b), (k, c)
    assert all(r.n_late == 0 for r in got.values())


def test_kpi_stream_counts_what_the_watermark_drops(spark, tmp_path):
    schema = "k string, ts timestamp_ntz, y double"
    source, out, progress = (str(tmp_path / x) for x in ("src", "out", "cp"))

    def run(rows):
        arrive(spark, source, rows, schema)
        query = stateful.kpi_stream(jobs.open_folder(spark, source, schema, "parquet"), out, progress, ["k"], freq="D", late="1 day")
        query.awaitTermination()
        return query

    at = lambda d: START + dt.timedelta(days=d)
    run([("a", at(k), 1.0) for k in range(10)])
    query = run([("a", at(1), 100.0), ("a", at(12), 1.0)])
    assert stateful.rows_too_late(query) == 1
    assert stateful.kpis_now(spark, out, [T.StructField("k", T.StringType())]).first().current_value in (0.0, 1.0)
    assert stateful.kpis_now(spark, str(tmp_path / "none"), [T.StructField("k", T.StringType())]).count() == 0
