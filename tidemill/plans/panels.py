"""Series built from the star-schema tables, each with the SQL that defines the same series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resample import closed_periods, resample
from .registry import table

NET_PRICE = "l_extendedprice * (1 - l_discount)"


def orders_monthly(spark: SparkSession, sf_dir: str, closed: bool = True) -> DataFrame:
    """Order value per month, one series; the month the data only partly covers is left out."""
    orders = table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice")
    series = resample(orders, [], "o_orderdate", "o_totalprice", "M", digits=2)
    return closed_periods(series, orders, "o_orderdate") if closed else series


def priority_monthly(spark: SparkSession, sf_dir: str, closed: bool = True) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), "o_orderdate", "o_totalprice")
    series = resample(orders, ["priority"], "o_orderdate", "o_totalprice", "M", digits=2)
    return closed_periods(series, orders, "o_orderdate") if closed else series


def nation_monthly(spark: SparkSession, sf_dir: str, closed: bool = True) -> DataFrame:
    """Order value per customer nation and month.

    One join, then partial sums per nation and month on the map side. The
    customer table grows with the data, so nothing is broadcast by hand: Spark
    does it below its size limit and otherwise splits a hot customer's orders.
    """
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    nations = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")
    )
    series = resample(orders.join(nations, "o_custkey"), ["nation"], "o_orderdate", "o_totalprice", "M", digits=2)
    return closed_periods(series, orders, "o_orderdate") if closed else series


def flag_monthly(spark: SparkSession, sf_dir: str, closed: bool = True) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_shipdate", F.expr(NET_PRICE).alias("net")
    )
    series = resample(lines, ["flag", "status"], "l_shipdate", "net", "M", digits=4)
    return closed_periods(series, lines, "l_shipdate") if closed else series


def part_monthly(spark: SparkSession, sf_dir: str, closed: bool = False) -> DataFrame:
    """Net line value per part and month: many sparse series, the panel that grows with the data."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part"), "l_shipdate", F.expr(NET_PRICE).alias("net")
    )
    series = resample(lines, ["part"], "l_shipdate", "net", "M", digits=4)
    return closed_periods(series, lines, "l_shipdate") if closed else series


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    return resample(events, ["event_type"], "ts", "value", "D", digits=2)


def text_columns(events: DataFrame) -> DataFrame:
    """The events as an untidy text table: unknown dates, missing and overflowing amounts."""
    return events.select(
        "user_id",
        "event_id",
        "event_type",
        F.when(F.col("event_type") == "error", "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("event_date"),
        F.when(F.col("event_type") == "signup", F.lit(None))
        .when(F.col("value") > 100, "overflow")
        .otherwise(F.col("value").cast("string"))
        .alias("amount"),
    )


def events_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_columns(table(spark, sf_dir, "events"))


# ---- the same series in SQL -----------------------------------------------------------

EVENTS_TEXT = """events_text AS (
  SELECT user_id, event_id, event_type,
    CASE WHEN event_type = 'error' THEN 'unknown' ELSE strftime(ts, '%Y-%m-%d') END AS event_date,
    CASE WHEN event_type = 'signup' THEN NULL WHEN value > 100 THEN 'overflow' ELSE CAST(value AS VARCHAR) END AS amount
  FROM events)"""


def monthly_cte(
    name: str, source: str, keys: dict[str, str], ts: str, value: str, digits: int, as_of: str | None = None
) -> str:
    """Common table expressions ending in ``name(keys…, ts, y)``: a dense monthly series."""
    made = "".join(f"{expr} AS {k}, " for k, expr in keys.items())
    names = "".join(f"{k}, " for k in keys)
    match = "".join(f" AND c.{k} IS NOT DISTINCT FROM r.{k}" for k in keys)
    closed = f" WHERE c.ts <= ({as_of})" if as_of else ""
    return f"""{name}_raw AS (SELECT {made}last_day({ts}) AS ts, sum({value}) AS s FROM {source} GROUP BY ALL),
{name}_span AS (SELECT {names}min(date_trunc('month', ts)) AS lo, max(date_trunc('month', ts)) AS hi FROM {name}_raw GROUP BY ALL),
{name}_cal AS (SELECT {names}last_day(unnest(generate_series(lo, hi, INTERVAL 1 MONTH))) AS ts FROM {name}_span),
{name} AS (SELECT c.*, round(coalesce(r.s, 0), {digits}) AS y FROM {name}_cal c
  LEFT JOIN {name}_raw r ON c.ts = r.ts{match}{closed})"""


_ORDERS_AS_OF = "SELECT CAST(max(o_orderdate) AS DATE) FROM orders"
_LINES_AS_OF = "SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem"
_NATION_SOURCE = "orders JOIN customer ON o_custkey = c_custkey"

ORDERS_M = monthly_cte("om", "orders", {}, "o_orderdate", "o_totalprice", 2, _ORDERS_AS_OF)
PRIORITY_M = monthly_cte("pm", "orders", {"priority": "o_orderpriority"}, "o_orderdate", "o_totalprice", 2, _ORDERS_AS_OF)
NATION_M = monthly_cte("nm", _NATION_SOURCE, {"nation": "c_nationkey"}, "o_orderdate", "o_totalprice", 2, _ORDERS_AS_OF)
FLAG_M = monthly_cte(
    "fm", "lineitem", {"flag": "l_returnflag", "status": "l_linestatus"}, "l_shipdate", NET_PRICE, 4, _LINES_AS_OF
)
# The same panels to the last row, the month that the data only partly covers included.
ORDERS_ALL = monthly_cte("om", "orders", {}, "o_orderdate", "o_totalprice", 2)
NATION_ALL = monthly_cte("nm", _NATION_SOURCE, {"nation": "c_nationkey"}, "o_orderdate", "o_totalprice", 2)
FLAG_ALL = monthly_cte("fm", "lineitem", {"flag": "l_returnflag", "status": "l_linestatus"}, "l_shipdate", NET_PRICE, 4)
PART_M = monthly_cte("ptm", "lineitem", {"part": "l_partkey"}, "l_shipdate", NET_PRICE, 4)
EVENTS_D = """ed_raw AS (SELECT event_type, CAST(ts AS DATE) AS ts, sum(value) AS s FROM events GROUP BY ALL),
ed_span AS (SELECT event_type, min(ts) AS lo, max(ts) AS hi FROM ed_raw GROUP BY ALL),
ed_cal AS (SELECT event_type, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ts FROM ed_span),
ed AS (SELECT c.*, round(coalesce(r.s, 0), 2) AS y FROM ed_cal c LEFT JOIN ed_raw r ON c.ts = r.ts AND c.event_type = r.event_type)"""


def names(keys: Sequence[str]) -> str:
    return ", ".join(keys)
