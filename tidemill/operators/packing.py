"""Series as one row each, for models that read a whole (bounded) series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pack_series(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", columns: Sequence[str] = ("y",)) -> DataFrame:
    """(keys, last_ts, one time-ordered array per column). Only for frames reduced to periods."""
    item = F.struct(F.col(ts).alias("t"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_s"), F.max(ts).alias("last_ts"))
    arrays = [F.col(f"_s.c{i}").alias(c) for i, c in enumerate(columns)]
    return packed.select(*keys, "last_ts", *arrays)


def key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def month_ends(forecast: DataFrame, last_ts: str = "last_ts") -> DataFrame:
    """Add ds: the step-th month end after the last time."""
    return forecast.withColumn("ds", F.last_day(F.add_months(F.trunc(last_ts, "month"), F.col("step"))))
