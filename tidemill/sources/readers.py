"""Reading tables by file type, listing files, and batch ingest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import clean, clean_report
from ..operators.profile import summary, validate

# File types that may be listed for ingest; spreadsheets are listed but not read.
ALLOWED = ("csv", "xlsx", "xls", "json")
READABLE = ("csv", "json", "parquet")
CORRUPT = "_corrupt_record"


def extension_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name else ""


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, **options) -> DataFrame:
    """CSV with a header. With a schema no inference pass runs, and rows that do not fit keep their
    text in ``_corrupt_record`` (add that column to the schema to receive it)."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.options(**options).csv(path)


def read_json(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, multiline: bool = True) -> DataFrame:
    """JSON: an array of records per file, or one record per line with ``multiline=False`` (splittable, for large files)."""
    reader = spark.read.option("multiLine", multiline)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def load(spark: SparkSession, path: str | list[str], file_type: str | None = None, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Read one path or glob by its type (given, or from the extension); unknown types fail before any job."""
    kind = (file_type or extension_of(path)).lower()
    if kind == "csv":
        return read_csv(spark, path, schema, **options)
    if kind == "json":
        return read_json(spark, path, schema, **options)
    if kind == "parquet":
        return (spark.read.schema(schema) if schema is not None else spark.read).parquet(*([path] if isinstance(path, str) else path))
    raise ValueError(f"unsupported file type {kind!r}; one of {READABLE}")


def load_many(spark: SparkSession, paths: Sequence[str], source_column: str | None = None, **options) -> DataFrame:
    """One table from files of different types and columns; columns a file lacks are null.

    With a schema, all paths of a type are one scan.
    """
    if not paths:
        raise ValueError("no paths given")
    if options.get("schema") is not None and not source_column:
        kinds: dict[str, list[str]] = {}
        for p in paths:
            kinds.setdefault((options.get("file_type") or extension_of(p)).lower(), []).append(p)
        schema, rest = options["schema"], {k: v for k, v in options.items() if k not in ("schema", "file_type")}
        frames = [load(spark, own, kind, schema, **rest) for kind, own in kinds.items()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    frames = [load(spark, p, **options) for p in paths]
    if source_column:
        frames = [f.withColumn(source_column, F.lit(p)) for f, p in zip(frames, paths)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def file_inventory(spark: SparkSession, folder: str, extensions: Sequence[str] = ALLOWED) -> DataFrame:
    """(name, path, size, modified, extension) of the files with an allowed extension, newest first.

    File contents are never read: the content column is pruned from the scan.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    )
    listed = files.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        "path",
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"),
    )
    return listed.where(F.col("extension").isin(*extensions)).orderBy(F.desc("modified"), "name")


@dataclass
class Ingest:
    """The frames of one ingest; all lazy except the validity that decides whether to clean."""

    raw: DataFrame
    validation: DataFrame
    is_valid: bool
    cleaned: DataFrame | None = None
    report: DataFrame | None = None
    summary: DataFrame | None = None


def ingest(
    spark: SparkSession, path: str, keys: Sequence[str] = (), seq: str | None = None, schema: T.StructType | str | None = None, **options
) -> Ingest:
    """Load and validate a table; when every key is valid, also clean and summarise it."""
    raw = load(spark, path, schema=schema, **options)
    validation = validate(raw, keys=keys)
    counted = validation.agg(F.count("*").alias("n"), F.count_if(~F.col("is_valid")).alias("bad")).first()
    out = Ingest(raw, validation, counted["n"] > 0 and counted["bad"] == 0)
    if out.is_valid:
        out.cleaned = clean(raw, keys, seq=seq)
        out.report = clean_report(raw, keys, seq=seq)
        out.summary = summary(out.cleaned, keys)
    return out
