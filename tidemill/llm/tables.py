"""Tables that a job writes once and reads several times, in the folder the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir


def keep(df: DataFrame, purpose: str) -> DataFrame:
    """The frame written as Parquet under ``spark.checkpoint.dir`` and read again: it survives lost executors and cuts the lineage."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Most rows that are broadcast; each holds a few numbers or short texts, so this stays far below 100 MB.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, purpose: str) -> DataFrame:
    """The frame kept and, where counted to be few rows, marked for broadcast; beyond that the join is Spark's, which splits hot keys."""
    kept = keep(df, purpose)
    return F.broadcast(kept) if kept.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else kept


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
