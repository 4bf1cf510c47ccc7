"""Files in and out, and streams against batch."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from tests.conftest import one
from tidemill.operators import clean, resample
from tidemill.sources import readers, sinks
from tidemill.streaming import jobs


@pytest.fixture()
def csv_file(tmp_path, raw_lines):
    path = tmp_path / "in" / "series.csv"
    path.parent.mkdir()
    path.write_text("Year_Month,Sales\n" + "\n".join(f"{a or ''},{b or ''}" for a, b in raw_lines))
    return str(path)


def test_csv_and_json_read_alike(spark, csv_file, tmp_path, raw_lines):
    records = [{"Year_Month": a, "Sales": b} for a, b in raw_lines]
    (tmp_path / "series.json").write_text(json.dumps(records))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in records))
    schema = "Year_Month string, Sales string"
    from_csv = clean.clean(readers.load(spark, csv_file, schema=schema))
    from_json = clean.clean(readers.load(spark, str(tmp_path / "series.json"), schema=schema))
    from_lines = clean.clean(readers.load(spark, str(tmp_path / "lines.json"), schema=schema, multiline=False))
    rows = sorted(from_csv.collect())
    assert rows == sorted(from_json.collect()) == sorted(from_lines.collect()) and len(rows) == 105
    assert clean.clean(readers.load(spark, csv_file)).count() == 105  # inferred types


def test_unknown_type_fails_before_any_job(spark):
    with pytest.raises(ValueError):
        readers.load(spark, "table.xlsx")
    with pytest.raises(ValueError):
        readers.load_many(spark, [])


def test_malformed_rows_keep_their_text(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("date,value\n2020-01-01,1\n2020-01-02,oops\n")
    df = readers.read_csv(spark, str(tmp_path / "bad.csv"), "date string, value int, _corrupt_record string")
    got = {r.date: (r.value, r._corrupt_record) for r in df.collect()}
    assert got == {"2020-01-01": (1, None), "2020-01-02": (None, "2020-01-02,oops")}


def test_one_panel_from_many_files(spark, csv_file, tmp_path):
    (tmp_path / "more.json").write_text('[{"Year_Month": "1973-01", "Region": "north"}]')
    df = readers.load_many(spark, [csv_file, str(tmp_path / "more.json")], source_column="source")
    assert df.count() == 108 and set(df.columns) == {"Year_Month", "Sales", "Region", "source"}


def test_inventory(spark, tmp_path):
    for name in ("a.csv", "b.XLSX", "c.txt", "d.json"):
        (tmp_path / name).write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.csv").write_text("xyz")
    got = readers.file_inventory(spark, str(tmp_path))
    assert {(r.name, r.extension, r["size"]) for r in got.collect()} == {("a.csv", "csv", 1), ("b.XLSX", "xlsx", 1), ("d.json", "json", 1), ("e.csv", "csv", 3)}


def test_ingest(spark, csv_file, tmp_path):
    done = readers.ingest(spark, csv_file)
    assert done.is_valid and done.cleaned.count() == 105 and one(done.report).invalid_dates == 2 and one(done.summary).median == 4217
    (tmp_path / "roleless.csv").write_text("a,b\n1,2\n")
    refused = readers.ingest(spark, str(tmp_path / "roleless.csv"))
    assert not refused.is_valid and refused.cleaned is None


@pytest.mark.parametrize("fmt", sinks.FORMATS)
def test_export_round_trip_keeps_the_date(spark, series, tmp_path, fmt):
    done = sinks.export(series, str(tmp_path / "out"), fmt)
    assert done.records == 105
    back = {"csv": lambda p: readers.read_csv(spark, p, "ts date, y double"), "json": lambda p: readers.read_json(spark, p, "ts date, y double", False),
            "parquet": spark.read.parquet}[fmt](str(tmp_path / "out"))
    assert sorted(back.collect()) == sorted(series.collect())
    with pytest.raises(Exception):
        sinks.export(series, str(tmp_path / "out"), fmt)  # never overwrites unless asked
    with pytest.raises(ValueError):
        sinks.export(series, str(tmp_path / "other"), "xlsx")


def test_stream_ingest_equals_batch(spark, csv_file, tmp_path):
    folder, out = csv_file.rsplit("/", 1)[0], str(tmp_path / "landed")
    schema = "Year_Month string, Sales string"
    start = lambda: jobs.ingest_stream(jobs.open_folder(spark, folder, schema), out, str(tmp_path / "progress")).awaitTermination()
    start()
    with open(f"{folder}/late.csv", "w") as f:
        f.write("Year_Month,Sales\n1972-10,6000\n1972-11,lots\n")
    start()  # only the new file is read
    start()  # nothing new
    rows = jobs.landed(spark, out)
    counts = {r.verdict: r["count"] for r in rows.groupBy("verdict").count().collect()}
    assert counts == {"good": 106, "bad_time": 2, "bad_value": 1}
    bad = rows.where("verdict = 'bad_value'").first()
    assert (bad.raw_ts, bad.raw_y) == ("1972-11", "lots")
    streamed = clean.clean(rows.where("verdict = 'good'").select("ts", "y"), ts="ts", y="y")
    batch = clean.clean(readers.load_many(spark, [f"{folder}/series.csv", f"{folder}/late.csv"], schema=schema))
    assert sorted(r[:2] for r in streamed.collect()) == sorted(tuple(r[:2]) for r in batch.collect())


def test_daily_stream_writes_closed_days_once(spark, tmp_path):
    source, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = "k string, ts timestamp_ntz, y double"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.daily_stream(jobs.open_folder(spark, source, schema, "parquet"), out, str(tmp_path / "cp"), ["k"], late="6 hours").awaitTermination()
        return {(r.k, str(r.ts)): (r.y, r.n) for r in spark.read.schema("k string, ts date, y double, n bigint").parquet(out).collect()}

    at = lambda d, h: dt.datetime(2024, 1, d, h)
    first = arrive([("a", at(1, 1), 1.0), ("a", at(1, 23), 2.0), ("b", at(1, 5), 5.0), ("a", at(2, 5), 1.0)])
    assert first == {}  # the first day stays open until the watermark passes midnight
    second = arrive([("a", at(1, 22), 4.0), ("a", at(2, 9), 1.0)])  # late but within the limit
    assert second == {("a", "2024-01-01"): (7.0, 3), ("b", "2024-01-01"): (5.0, 1)}
    third = arrive([("b", at(1, 1), 100.0), ("a", at(3, 12), 1.0)])  # too late: dropped
    assert third == {**second, ("a", "2024-01-02"): (2.0, 2)}


def test_weekly_stream_labels_sundays_like_batch(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, d, 12), float(d)) for d in range(1, 29)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, y double")
    df.coalesce(1).write.parquet(str(tmp_path / "src"))
    stream = jobs.open_folder(spark, str(tmp_path / "src"), df.schema, "parquet")
    jobs.daily_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), late="1 hour", freq="W").awaitTermination()
    got = {str(r.ts): r.y for r in spark.read.schema("ts date, y double, n bigint").parquet(str(tmp_path / "out")).collect()}
    batch = {str(r.ts): r.y for r in resample.resample(df, freq="W").collect()}
    assert got == {t: y for t, y in batch.items() if t < "2024-01-28"} and len(got) == 3
