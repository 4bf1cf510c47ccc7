"""Sources, cleaning, validation and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, profile, resample
from ..sources import readers
from . import panels
from .panels import EVENTS_TEXT, FLAG_ALL, NATION_ALL, ORDERS_ALL, PART_M
from .registry import query, table


@query(
    "preview",
    "o_orderkey:i o_custkey:i o_orderdate:d o_totalprice:2",
    "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50",
)
def _preview(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return profile.preview(orders, 50, ("o_orderdate", "o_orderkey"))


@query(
    "table_shape",
    "n_rows:i n_columns:i columns:s",
    """SELECT count(*) AS n_rows, 6 AS n_columns, 'o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string' AS columns FROM orders""",
)
def _shape(spark, sf):
    return profile.shape(table(spark, sf, "orders")).withColumn("columns", F.array_join("columns", ", "))


@query("file_inventory", "name:s extension:s size:i")
def _inventory(spark, sf):
    return readers.file_inventory(spark, sf, extensions=("parquet",))


@query("tail_n", "ts:d y:2", f"WITH {ORDERS_ALL} SELECT ts, y FROM om ORDER BY ts DESC LIMIT 50")
def _tail(spark, sf):
    return profile.tail_rows(panels.orders_monthly(spark, sf, closed=False), 50)


@query(
    "clean_series",
    "user_id:i ts:d y:2 event_id:i event_type:s",
    f"""WITH {EVENTS_TEXT},
timed AS (SELECT *, try_cast(event_date AS DATE) AS ts FROM events_text WHERE try_cast(event_date AS DATE) IS NOT NULL),
filled AS (SELECT *, coalesce(
    last_value(amount IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(amount IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS full_amount
  FROM timed),
latest AS (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS rn FROM filled)
SELECT user_id, ts, try_cast(full_amount AS DOUBLE) AS y, event_id, event_type FROM latest
WHERE rn = 1 AND try_cast(full_amount AS DOUBLE) IS NOT NULL""",
)
def _clean(spark, sf):
    return clean.clean(panels.events_text(spark, sf), ["user_id"], seq="event_id")


@query(
    "clean_report",
    "user_id:i rows_in:i invalid_dates:i missing_filled:i duplicates_removed:i non_numeric_removed:i rows_out:i",
    f"""WITH {EVENTS_TEXT},
typed AS (SELECT *, try_cast(event_date AS DATE) AS ts FROM events_text),
filled AS (SELECT *, coalesce(
    last_value(amount IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(amount IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS full_amount
  FROM typed WHERE ts IS NOT NULL),
latest AS (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS rn FROM filled),
kept AS (SELECT user_id, count(*) FILTER (try_cast(full_amount AS DOUBLE) IS NULL) AS non_numeric_removed,
    count(*) FILTER (try_cast(full_amount AS DOUBLE) IS NOT NULL) AS rows_out FROM latest WHERE rn = 1 GROUP BY 1),
counted AS (SELECT user_id, count(*) AS rows_in, count(*) FILTER (ts IS NULL) AS invalid_dates,
    count(*) FILTER (ts IS NOT NULL AND amount IS NULL) AS missing_filled,
    count(*) FILTER (ts IS NOT NULL) - count(DISTINCT ts) AS duplicates_removed FROM typed GROUP BY 1)
SELECT c.*, coalesce(k.non_numeric_removed, 0) AS non_numeric_removed, coalesce(k.rows_out, 0) AS rows_out
FROM counted c LEFT JOIN kept k USING (user_id)""",
)
def _clean_report(spark, sf):
    return clean.clean_report(panels.events_text(spark, sf), ["user_id"], "event_date", "amount", seq="event_id")


@query(
    "fill_missing",
    "o_orderkey:i filled:2",
    """WITH s AS (SELECT o_orderpriority, o_orderdate, o_orderkey,
    CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS y FROM orders)
SELECT o_orderkey, coalesce(
  last_value(y IGNORE NULLS) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(y IGNORE NULLS) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled
FROM s""",
)
def _fill(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderpriority", "o_orderdate", "o_orderkey", F.expr("CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END").alias("y")
    )
    return clean.fill_missing(orders, ["o_orderpriority"], "o_orderdate", "y", ["o_orderkey"], out="filled")


@query(
    "dedupe_last",
    "o_custkey:i o_orderdate:d o_orderkey:i o_totalprice:2 o_orderstatus:s",
    """SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice,
  arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey, o_orderdate""",
)
def _dedupe(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderstatus")
    return clean.dedupe_last(orders, ["o_custkey", "o_orderdate"], "o_orderkey")


_SPARSE_SQL = """SELECT CASE WHEN event_type IN ('click', 'view') THEN '' ELSE event_type END AS kind,
  CASE WHEN value > 50 THEN value END AS large, CASE WHEN event_type = 'signup' THEN NULL ELSE '' END AS note FROM events"""


@query(
    "drop_empty_rows",
    "kind:s large:2 note:s",
    f"SELECT * FROM ({_SPARSE_SQL}) WHERE coalesce(kind, '') <> '' OR large IS NOT NULL OR coalesce(note, '') <> ''",
)
def _drop_empty(spark, sf):
    sparse = table(spark, sf, "events").select(
        F.expr("CASE WHEN event_type IN ('click', 'view') THEN '' ELSE event_type END").alias("kind"),
        F.expr("CASE WHEN value > 50 THEN value END").alias("large"),
        F.expr("CASE WHEN event_type = 'signup' THEN NULL ELSE '' END").alias("note"),
    )
    return clean.drop_empty_rows(sparse)


@query(
    "convert_types",
    "event_id:i amount:2 event_date:d paid:b user_id:s",
    f"""WITH {EVENTS_TEXT}
SELECT event_id, try_cast(amount AS DOUBLE) AS amount, try_cast(event_date AS DATE) AS event_date,
  event_type = 'purchase' AS paid, CAST(user_id AS VARCHAR) AS user_id FROM events_text""",
)
def _convert(spark, sf):
    raw = panels.events_text(spark, sf).select(
        "event_id",
        "amount",
        "event_date",
        F.expr("CASE event_type WHEN 'purchase' THEN 'true' WHEN 'view' THEN 'no' ELSE NULL END").alias("paid"),
        "user_id",
    )
    return clean.convert_types(raw, {"amount": "number", "event_date": "date", "paid": "boolean", "user_id": "string"})


@query(
    "trailing_range",
    "nation:i ts:d y:2",
    f"""WITH {NATION_ALL}, m AS (SELECT nation, max(ts) AS hi FROM nm GROUP BY 1)
SELECT nm.nation, ts, y FROM nm JOIN m USING (nation) WHERE ts > hi - INTERVAL 12 MONTH""",
)
def _trailing(spark, sf):
    return clean.trailing_range(panels.nation_monthly(spark, sf, closed=False), "1Y", ["nation"])


@query(
    "validate",
    "total_records:i missing_dates:i missing_values:i duplicate_dates:i start_date:d end_date:d "
    "mean_value:4 std_value:4 min_value:2 max_value:2 is_valid:b",
    """SELECT count(*) AS total_records, count(*) FILTER (o_orderdate IS NULL) AS missing_dates,
  count(*) FILTER (o_totalprice IS NULL) AS missing_values, count(*) - count(DISTINCT o_orderdate) AS duplicate_dates,
  min(o_orderdate) AS start_date, max(o_orderdate) AS end_date, avg(o_totalprice) AS mean_value,
  stddev_samp(o_totalprice) AS std_value, min(o_totalprice) AS min_value, max(o_totalprice) AS max_value,
  count(*) > 0 AS is_valid FROM orders""",
)
def _validate(spark, sf):
    return profile.validate(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")


def _frequency_sql(source: str, key: str, ts: str) -> str:
    return f"""days AS (SELECT DISTINCT {key} AS k, {ts} AS d FROM {source}),
gaps AS (SELECT k, date_diff('day', lag(d) OVER (PARTITION BY k ORDER BY d), d) AS gap FROM days),
counted AS (SELECT k, gap, count(*) AS c FROM gaps WHERE gap IS NOT NULL GROUP BY ALL),
modal AS (SELECT k, gap FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c DESC, gap) AS rn FROM counted) WHERE rn = 1),
freq AS (SELECT k, gap, CASE WHEN gap <= 1 THEN 'D' WHEN gap <= 7 THEN 'W' WHEN gap <= 31 THEN 'M' WHEN gap <= 93 THEN 'Q' ELSE 'Y' END AS frequency FROM modal)"""


@query(
    "summary",
    "priority:s n_rows:i start_ts:d end_ts:d mean:4 median:4 std:4 min:2 max:2 q25:4 q75:4 frequency:s missing_values:i zero_values:i",
    f"""WITH {_frequency_sql('orders', 'o_orderpriority', 'o_orderdate')}
SELECT o_orderpriority AS priority, count(*) AS n_rows, min(o_orderdate) AS start_ts, max(o_orderdate) AS end_ts,
  avg(o_totalprice) AS mean, quantile_cont(o_totalprice, 0.5) AS median, stddev_samp(o_totalprice) AS std,
  min(o_totalprice) AS min, max(o_totalprice) AS max, quantile_cont(o_totalprice, 0.25) AS q25,
  quantile_cont(o_totalprice, 0.75) AS q75, any_value(frequency) AS frequency,
  count(*) FILTER (o_totalprice IS NULL) AS missing_values, count(*) FILTER (o_totalprice = 0) AS zero_values
FROM orders JOIN freq ON o_orderpriority = k GROUP BY 1""",
)
def _summary(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority"), "o_orderdate", "o_totalprice")
    return profile.summary(orders, ["priority"], "o_orderdate", "o_totalprice")


@query(
    "distribution_stats",
    "flag:s status:s n_rows:i mean:4 median:4 std:4 q25:4 q75:4 skewness:6 kurtosis:6 variance:2",
    """SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n_rows, avg(l_extendedprice) AS mean,
  quantile_cont(l_extendedprice, 0.5) AS median, stddev_samp(l_extendedprice) AS std,
  quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.75) AS q75,
  skewness(l_extendedprice) AS skewness, kurtosis(l_extendedprice) AS kurtosis, var_samp(l_extendedprice) AS variance
FROM lineitem GROUP BY 1, 2""",
)
def _distribution(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_shipdate", "l_extendedprice"
    )
    return profile.distribution_stats(lines, ["flag", "status"], "l_shipdate", "l_extendedprice")


@query(
    "yoy_growth",
    "nation:i n_growth:i mean_yoy_growth:6 std_yoy_growth:6 latest_yoy_growth:6",
    f"""WITH {NATION_ALL}, g AS (SELECT nation, ts, (y - lag(y, 12) OVER w) / nullif(lag(y, 12) OVER w, 0) AS g FROM nm
  WINDOW w AS (PARTITION BY nation ORDER BY ts))
SELECT nation, count(g) AS n_growth, avg(g) AS mean_yoy_growth, stddev_samp(g) AS std_yoy_growth,
  arg_max(g, ts) FILTER (g IS NOT NULL) AS latest_yoy_growth FROM g GROUP BY 1""",
)
def _yoy(spark, sf):
    return profile.yoy_growth(panels.nation_monthly(spark, sf, closed=False), ["nation"])


def _season(part: str) -> None:
    @query(
        f"seasonal_profile_{part}",
        f"nation:i {part}:i mean:6 std:4 n:i",
        f"WITH {NATION_ALL} SELECT nation, {part}(ts) AS {part}, avg(y) AS mean, stddev_samp(y) AS std, count(y) AS n FROM nm GROUP BY 1, 2",
    )
    def _profile(spark, sf):
        return profile.seasonal_profile(panels.nation_monthly(spark, sf, closed=False), ["nation"], part=part)


_season("month")
_season("quarter")


@query(
    "seasonality_strength",
    "nation:i peak_month:i trough_month:i seasonality_strength:6",
    f"""WITH {NATION_ALL}, m AS (SELECT nation, month(ts) AS month, avg(y) AS mean FROM nm GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY mean DESC, month) AS hi,
  row_number() OVER (PARTITION BY nation ORDER BY mean, month) AS lo FROM m)
SELECT nation, max(month) FILTER (hi = 1) AS peak_month, max(month) FILTER (lo = 1) AS trough_month,
  stddev_samp(mean) / avg(mean) AS seasonality_strength FROM r GROUP BY 1""",
)
def _strength(spark, sf):
    return profile.seasonality_strength(panels.nation_monthly(spark, sf, closed=False), ["nation"])


@query(
    "yearly_growth",
    "flag:s status:s year:i year_mean:6 year_growth:6",
    f"""WITH {FLAG_ALL}, a AS (SELECT flag, status, year(ts) AS year, avg(y) AS year_mean FROM fm GROUP BY 1, 2, 3)
SELECT *, (year_mean - lag(year_mean) OVER w) / nullif(lag(year_mean) OVER w, 0) AS year_growth FROM a
WINDOW w AS (PARTITION BY flag, status ORDER BY year) QUALIFY count(*) OVER (PARTITION BY flag, status) >= 3""",
)
def _yearly(spark, sf):
    return profile.yearly_growth(panels.flag_monthly(spark, sf, closed=False), ["flag", "status"])


@query(
    "detect_frequency",
    "o_custkey:i n_obs:i modal_days:i frequency:s",
    f"""WITH {_frequency_sql('orders', 'o_custkey', 'o_orderdate')},
sized AS (SELECT o_custkey, count(o_orderdate) AS n_obs FROM orders GROUP BY 1)
SELECT o_custkey, n_obs, gap AS modal_days, coalesce(frequency, 'M') AS frequency FROM sized LEFT JOIN freq ON o_custkey = k""",
)
def _frequency(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate")
    return profile.detect_frequency(orders, ["o_custkey"], "o_orderdate", block="year")


def _quality_sql() -> str:
    def text(c: str) -> str:
        return f"""SELECT '{c}' AS column_name, 'string' AS data_type, count(*) FILTER (coalesce({c}, '') = '') AS missing,
  min(try_cast({c} AS DOUBLE)) AS min_value, max(try_cast({c} AS DOUBLE)) AS max_value, avg(try_cast({c} AS DOUBLE)) AS mean_value FROM events_text"""

    def number(c: str) -> str:
        return f"""SELECT '{c}', 'bigint', count(*) FILTER ({c} IS NULL), min({c}::DOUBLE), max({c}::DOUBLE), avg({c}::DOUBLE) FROM events_text"""

    return f"""WITH {EVENTS_TEXT},
cols AS ({text('event_date')} UNION ALL {text('amount')} UNION ALL {text('event_type')} UNION ALL {number('user_id')}),
tot AS (SELECT count(*) AS total_records, count(*) - (SELECT count(*) FROM (SELECT DISTINCT event_date, amount, event_type, user_id FROM events_text)) AS duplicate_records FROM events_text)
SELECT *, sum(missing) OVER () AS missing_total, greatest(0, 100 - sum(missing) OVER () * 50.0 / (total_records * 4)) AS quality_score FROM cols, tot"""


@query(
    "quality_report",
    "total_records:i missing_total:i duplicate_records:i quality_score:6 column_name:s data_type:s missing:i min_value:2 max_value:2 mean_value:6",
    _quality_sql(),
)
def _quality(spark, sf):
    return profile.quality_report(panels.events_text(spark, sf).select("event_date", "amount", "event_type", "user_id"))


# ---- resampling and calendars -----------------------------------------------------------


def _resample(freq: str, label: str, end_sql: str, step_sql: str, start_sql: str) -> None:
    end_of = end_sql.format("o_orderdate")
    sql = f"""WITH raw AS (SELECT o_orderpriority AS priority, {end_of} AS ts, sum(o_totalprice) AS s FROM orders GROUP BY ALL),
span AS (SELECT priority, min({start_sql}) AS lo, max({start_sql}) AS hi FROM raw GROUP BY 1),
cal AS (SELECT priority, unnest(generate_series(lo, hi, INTERVAL {step_sql})) AS d FROM span),
lab AS (SELECT priority, {end_sql.format('d')} AS ts FROM cal)
SELECT lab.priority, lab.ts, round(coalesce(s, 0), 2) AS y FROM lab LEFT JOIN raw ON lab.priority = raw.priority AND lab.ts = raw.ts"""

    @query(f"resample_{label}", "priority:s ts:d y:2", sql)
    def _run(spark, sf):
        orders = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority"), "o_orderdate", "o_totalprice")
        return resample.resample(orders, ["priority"], "o_orderdate", "o_totalprice", freq, digits=2)


_resample("D", "day", "CAST({0} AS DATE)", "1 DAY", "CAST(ts AS TIMESTAMP)")
_resample("W", "week", "CAST(date_trunc('week', {0}) AS DATE) + 6", "7 DAY", "date_trunc('week', ts)")
_resample("M", "month", "last_day({0})", "1 MONTH", "date_trunc('month', ts)")
_resample("Q", "quarter", "last_day(date_trunc('quarter', {0}) + INTERVAL 2 MONTH)", "3 MONTH", "date_trunc('quarter', ts)")
_resample("Y", "year", "make_date(year({0}), 12, 31)", "1 YEAR", "date_trunc('year', ts)")


@query("densify_month", "part:i ts:d y:4", f"WITH {PART_M} SELECT part, ts, y FROM ptm")
def _densify(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("part"), "l_shipdate", F.expr(panels.NET_PRICE).alias("net"))
    sums = resample.resample(lines, ["part"], "l_shipdate", "net", "M", digits=4, dense=False)
    return resample.densify(sums, ["part"], "M")


@query(
    "future_calendar",
    "nation:i step:i ds:d",
    f"""WITH {NATION_ALL}, m AS (SELECT nation, max(ts) AS hi FROM nm GROUP BY 1)
SELECT nation, step, last_day(date_trunc('month', hi) + to_months(CAST(step AS INTEGER))) AS ds FROM m, range(1, 13) AS r(step)""",
)
def _future(spark, sf):
    return resample.future_calendar(panels.nation_monthly(spark, sf, closed=False), 12, ["nation"])


@query(
    "seasonal_features",
    "event_type:s ts:d year:i month:i quarter:i day_of_year:i week_of_year:i month_sin:6 month_cos:6 quarter_sin:6 quarter_cos:6 is_holiday_season:i is_summer:i",
    f"""WITH {panels.EVENTS_D}, u AS (SELECT event_type, ts FROM ed
  UNION ALL SELECT o_orderstatus, CAST(o_orderdate AS DATE) FROM orders)
SELECT event_type, ts, year(ts) AS year, month(ts) AS month, quarter(ts) AS quarter, dayofyear(ts) AS day_of_year,
  weekofyear(ts) AS week_of_year, sin(2 * pi() * month(ts) / 12) AS month_sin, cos(2 * pi() * month(ts) / 12) AS month_cos,
  sin(2 * pi() * quarter(ts) / 4) AS quarter_sin, cos(2 * pi() * quarter(ts) / 4) AS quarter_cos,
  CASE WHEN month(ts) IN (12, 1) THEN 1 ELSE 0 END AS is_holiday_season,
  CASE WHEN month(ts) BETWEEN 6 AND 8 THEN 1 ELSE 0 END AS is_summer FROM u""",
)
def _seasonal_features(spark, sf):
    days = panels.events_daily(spark, sf).select("event_type", "ts")
    orders = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("event_type"), F.to_date("o_orderdate").alias("ts"))
    return resample.seasonal_features(days.unionByName(orders))
