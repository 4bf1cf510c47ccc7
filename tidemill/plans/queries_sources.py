"""Sources and sinks: tables written by an export and read back, whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean
from ..schema import tidy_column_names
from ..session import scratch_dir
from ..sources import readers, sinks
from .registry import query, table

_LINES = "order_key bigint, line bigint, quantity double, flag string, shipped date"
_SPEC = "order_key:i line:i quantity:2 flag:s shipped:d"
_SQL = """SELECT l_orderkey AS order_key, l_linenumber AS line, l_quantity AS quantity, l_returnflag AS flag, CAST(l_shipdate AS DATE) AS shipped
FROM lineitem"""


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"),
        F.col("l_returnflag").alias("flag"), F.to_date("l_shipdate").alias("shipped"),
    )


@query("csv_round_trip", _SPEC, _SQL)
def _csv(spark, sf):
    path = scratch_dir(spark, "export") + ".csv"
    sinks.export(_lines(spark, sf), path, "csv")
    return readers.load(spark, path, schema=_LINES)


@query("json_round_trip", _SPEC, _SQL)
def _json(spark, sf):
    path = scratch_dir(spark, "export") + ".json"
    sinks.export(_lines(spark, sf), path, "json")
    return readers.load(spark, path, schema=_LINES, multiline=False)


@query("load_many", _SPEC, _SQL)
def _many(spark, sf):
    """The same rows from three files of different types."""
    base, lines = scratch_dir(spark, "export"), _lines(spark, sf)
    paths = []
    for k, kind in enumerate(("csv", "parquet", "csv")):
        paths.append(f"{base}/{k}.{kind}")
        sinks.export(lines.where(F.col("order_key") % 3 == k), paths[-1], kind)
    return readers.load_many(spark, paths, schema=_LINES)


@query(
    "ingest_batch",
    "priority:s rows_in:i invalid_dates:i missing_filled:i duplicates_removed:i non_numeric_removed:i rows_out:i",
    """SELECT o_orderpriority AS priority, count(*) AS rows_in, 0 AS invalid_dates, 0 AS missing_filled,
  count(*) - count(DISTINCT o_orderdate) AS duplicates_removed, 0 AS non_numeric_removed, count(DISTINCT o_orderdate) AS rows_out
FROM orders GROUP BY 1""",
)
def _ingest_batch(spark, sf):
    """Orders as an uploaded file: loaded, validated, cleaned and reported."""
    path = scratch_dir(spark, "upload") + ".csv"
    orders = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.col("o_totalprice").alias("sales"), F.col("o_orderkey").alias("seq"),
    )
    sinks.export(orders, path, "csv")
    return readers.ingest(spark, path, ["priority"], "seq", schema="priority string, date string, sales string, seq bigint").report


@query(
    "tidy_names",
    "o_totalprice:2 order_status:s o_clerks_name:i",
    "SELECT o_totalprice, o_orderstatus AS order_status, o_orderkey AS o_clerks_name FROM orders",
)
def _tidy(spark, sf):
    untidy = table(spark, sf, "orders").select("o_totalprice", F.col("o_orderstatus").alias(" Order Status"), F.col("o_orderkey").alias("O Clerk-s Name"))
    return tidy_column_names(untidy)


@query("align_pairs", "priority:s ts:d y:2 yhat:2", """WITH d AS (SELECT o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS ts, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1, 2)
SELECT a.priority, a.ts, a.y, b.y AS yhat FROM d AS a JOIN d AS b ON a.priority = b.priority AND a.ts = b.ts + INTERVAL 7 DAY""")
def _align(spark, sf):
    """Each day's order value beside that of a week before."""
    orders = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").alias("ts"))
    days = orders.agg(F.round(F.sum("o_totalprice"), 2).alias("y"))
    return clean.align_pairs(days, days.select("priority", F.date_add("ts", 7).alias("ts"), F.col("y").alias("yhat")), ["priority"])
