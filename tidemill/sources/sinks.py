"""Writing results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

FORMATS = ("csv", "json", "parquet")


@dataclass
class Export:
    path: str
    format: str
    records: int


def export(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists", partition_by: list[str] | None = None) -> Export:
    """Write csv (with header), json (one record per line, ISO dates, date kept) or parquet.

    The record count is observed while writing, not counted by a second pass.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unsupported export format {fmt!r}; one of {FORMATS}")
    seen = Observation("export")
    writer = df.observe(seen, F.count(F.lit(1)).alias("records")).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        writer.parquet(path)
    return Export(path, fmt, seen.get["records"])
