"""Streaming queries: the event table read as a stream until it is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_dir
from ..streaming import jobs, stateful
from . import panels
from .panels import EVENTS_TEXT, monthly_cte
from .queries_trend import KPI_SPEC, kpi_sql
from .registry import query, table


def _event_stream(spark, sf):
    return jobs.open_table(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema)


@query(
    "stream_ingest",
    "event_id:i user_id:i event_type:s verdict:s ts:d y:2 raw_y:s",
    f"""WITH {EVENTS_TEXT}
SELECT event_id, user_id, event_type, try_cast(event_date AS DATE) AS ts, try_cast(amount AS DOUBLE) AS y, amount AS raw_y,
  CASE WHEN try_cast(event_date AS DATE) IS NULL THEN 'bad_time' WHEN amount IS NOT NULL AND try_cast(amount AS DOUBLE) IS NULL THEN 'bad_value' ELSE 'good' END AS verdict
FROM events_text""",
)
def _ingest(spark, sf):
    work = scratch_dir(spark, "stream_ingest")
    rows = panels.text_columns(_event_stream(spark, sf))
    jobs.ingest_stream(rows, f"{work}/landed", f"{work}/progress", ["user_id"]).awaitTermination()
    return jobs.landed(spark, f"{work}/landed", jobs.sorted_rows(rows, ["user_id"]).schema)


@query(
    "stream_daily",
    "event_type:s ts:d y:2 n:i",
    """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS y, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, day AS ts, y, n FROM d WHERE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""",
)
def _daily(spark, sf):
    work = scratch_dir(spark, "stream_daily")
    out = f"{work}/daily"
    jobs.daily_stream(
        _event_stream(spark, sf), out, f"{work}/progress", ["event_type"], "ts", "value", late="2 hours"
    ).awaitTermination()
    return spark.read.schema("event_type string, ts date, y double, n bigint").parquet(out).withColumn("y", F.round("y", 2))


_PRIORITIES = monthly_cte("pm", "orders", {"priority": "o_orderpriority"}, "o_orderdate", "o_totalprice", 2)


@query(
    "stream_kpis",
    "priority:s " + KPI_SPEC,
    f"""WITH {_PRIORITIES}, closed AS (SELECT * FROM pm WHERE CAST(ts AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(o_orderdate) - INTERVAL 20 DAY FROM orders)),
{kpi_sql("closed", "priority")}""",
)
def _kpis(spark, sf):
    """KPIs kept in the stream's state, of all months that twenty days after their end have closed."""
    work = scratch_dir(spark, "stream_kpis")
    orders = jobs.open_table(spark, f"{sf}/orders.parquet", table(spark, sf, "orders").schema).withColumnRenamed("o_orderpriority", "priority")
    stateful.kpi_stream(orders, f"{work}/kpis", f"{work}/progress", ["priority"], "o_orderdate", "o_totalprice", late="20 days", digits=2).awaitTermination()
    return stateful.kpis_now(spark, f"{work}/kpis", [orders.schema["priority"]])


@query(
    "stream_clean",
    "event_type:s ts:d y:2",
    f"""WITH {EVENTS_TEXT},
t AS (SELECT event_type, try_cast(event_date AS DATE) AS ts, amount, event_id FROM events_text WHERE try_cast(event_date AS DATE) IS NOT NULL),
g AS (SELECT event_type, ts, arg_max(amount, event_id) FILTER (amount IS NOT NULL) AS v, arg_min(amount, event_id) FILTER (amount IS NOT NULL) AS f FROM t GROUP BY 1, 2),
c AS (SELECT event_type, ts, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(f IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM g)
SELECT event_type, ts, try_cast(v AS DOUBLE) AS y FROM c WHERE try_cast(v AS DOUBLE) IS NOT NULL""",
)
def _clean(spark, sf):
    """The untidy event texts cleaned as they arrive."""
    work = scratch_dir(spark, "stream_clean")
    rows = panels.text_columns(_event_stream(spark, sf))
    stateful.clean_stream(rows, f"{work}/rows", f"{work}/progress", "event_id", ["event_type"], "event_date", "amount", late="400 days").awaitTermination()
    return stateful.cleaned(spark, f"{work}/rows", [rows.schema["event_type"]])
