"""Registration of runnable queries with their SQL counterparts.

A query states its output columns once, as ``name:kind`` words: ``i`` whole
number, ``s`` text, ``d`` date as yyyy-MM-dd text, ``b`` flag, a digit for a
double rounded to that many places. The same statement shapes the Spark result
and wraps the SQL, so both always agree on names, types and rounding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spec(columns: str) -> list[tuple[str, str]]:
    return [tuple(word.rsplit(":", 1)) for word in columns.split()]


def shape_frame(df: DataFrame, columns: str) -> DataFrame:
    def one(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind == "i":
            return c.cast("bigint").alias(name)
        if kind == "s":
            return c.cast("string").alias(name)
        if kind == "d":
            return F.date_format(c, "yyyy-MM-dd").alias(name)
        if kind == "b":
            return c.cast("boolean").alias(name)
        # adding zero turns a rounded -0.0 into 0.0
        return (F.round(c.cast("double"), int(kind)) + F.lit(0.0)).alias(name)

    return df.select(*[one(n, k) for n, k in _spec(columns)])


def shape_sql(sql: str, columns: str) -> str:
    def one(name: str, kind: str) -> str:
        q = f'"{name}"'
        if kind == "i":
            return f"CAST({q} AS BIGINT) AS {q}"
        if kind == "s":
            return f"CAST({q} AS VARCHAR) AS {q}"
        if kind == "d":
            return f"strftime({q}, '%Y-%m-%d') AS {q}"
        if kind == "b":
            return f"CAST({q} AS BOOLEAN) AS {q}"
        return f"round(CAST({q} AS DOUBLE), {int(kind)}) + 0.0 AS {q}"

    return f"SELECT {', '.join(one(n, k) for n, k in _spec(columns))} FROM (\n{sql.strip()}\n) AS result"


def query(name: str, columns: str | None = None, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL it is checked by rows here and by tests."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return shape_frame(df, columns) if columns else df

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = shape_sql(sql, columns) if columns else sql
        return fn

    return register
