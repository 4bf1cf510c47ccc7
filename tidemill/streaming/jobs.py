"""Streaming ingest and incremental resampling.

Every job keeps its progress in a checkpoint folder that must be shared by the
cluster, writes each micro-batch so that repeating it changes nothing, and can
run continuously or until the input is used up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import clock_seconds, period_end
from ..operators.clean import TIME_FORMATS, parse_time, to_number
from ..schema import require_roles


def open_folder(
    spark: SparkSession, folder: str, schema: T.StructType | str, fmt: str = "csv", files_per_batch: int | None = None, glob: str | None = None
) -> DataFrame:
    """Stream the files that arrive in a folder. A schema is required: inference would differ between files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if fmt == "csv":
        return reader.option("header", True).csv(folder)
    if fmt in ("json", "parquet"):
        return reader.format(fmt).load(folder)
    raise ValueError(f"unsupported stream format {fmt!r}; csv, json or parquet")


def open_table(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet") -> DataFrame:
    """Stream a table that is a folder of part files or one file; no such path is an error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        raise FileNotFoundError(path)
    if files.getFileStatus(place).isDirectory():
        return open_folder(spark, path, schema, fmt)
    return open_folder(spark, place.getParent().toString(), schema, fmt, glob=place.getName())


def sorted_rows(
    df: DataFrame, keys: Sequence[str] = (), ts: str | None = None, y: str | None = None, formats: Sequence[str] = TIME_FORMATS
) -> DataFrame:
    """Typed columns ts and y beside the originals, and ``verdict``: good, bad_time or bad_value.

    A missing value is good (cleaning fills it); a text that is no number is not.
    """
    if ts is None or y is None:
        ts, y = require_roles([c for c in df.columns if c not in keys])
    typed = df.withColumnsRenamed({ts: "raw_ts", y: "raw_y"})
    value = to_number("raw_y")
    time = parse_time(typed, "raw_ts", formats)
    verdict = (
        F.when(time.isNull(), "bad_time").when(F.col("raw_y").isNotNull() & value.isNull(), "bad_value").otherwise("good")
    )
    return typed.withColumns({"ts": time, "y": value, "verdict": verdict})


def ingest_stream(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    keys: Sequence[str] = (),
    ts: str | None = None,
    y: str | None = None,
    once: bool = True,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Type the rows and land them under ``out`` by verdict, bad ones kept with their original text.

    Each batch is written in one pass to its own folder, overwritten if the
    batch is repeated, so a retry after a lost executor leaves no duplicates.
    """
    rows = sorted_rows(stream, keys, ts, y)

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("verdict").parquet(f"{out}/batch_id={batch_id}")

    writer = rows.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def landed(spark: SparkSession, out: str, schema: T.StructType | None = None) -> DataFrame:
    """All landed rows with their ``batch_id`` and ``verdict``; none when nothing has landed and the ``schema`` of the rows is given."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/batch_id=*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    if schema is not None and not found:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch_id", T.IntegerType())]))
    return spark.read.option("basePath", out).parquet(f"{out}/batch_id=*")


def daily_stream(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    keys: Sequence[str] = (),
    ts: str = "ts",
    y: str = "y",
    late: str = "1 day",
    freq: str = "D",
    once: bool = True,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Sums and counts per key and day (D) or week (W), each written once, when no later row can change it.

    Rows more than ``late`` behind the newest are dropped by the watermark; the
    newest period stays open until the watermark passes its end. State holds one
    row per key and open period.
    """
    length = {"D": "1 day", "W": "7 days"}[freq]
    # seven-day windows count from 1970-01-01, a Thursday; four days later they start on Mondays
    start = "4 days" if freq == "W" else "0 days"
    # watermarks need an instant: the wall clock is read as UTC on the way in and out
    timed = stream.select(*keys, F.timestamp_seconds(clock_seconds(ts)).alias("_ts"), F.col(y).cast("double").alias("_y"))
    day = F.date_from_unix_date(F.floor(F.unix_seconds(F.col("_w.start")) / 86400).cast("int"))
    sums = (
        timed.withWatermark("_ts", late)
        .groupBy(*keys, F.window("_ts", length, length, start).alias("_w"))
        .agg(F.sum("_y").alias("y"), F.count("*").alias("n"))
        .select(*keys, period_end(day, freq).alias("ts"), "y", "n")
    )
    writer = sums.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()
