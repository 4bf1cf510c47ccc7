"""Outlier detection, summary and treatment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly
from . import panels
from .panels import NATION_ALL
from .registry import query, table

_FENCES = """q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q)"""


def _events(spark, sf):
    return table(spark, sf, "events").select("event_type", "event_id", "value")


@query(
    "outlier_iqr",
    "event_id:i is_outlier_iqr:b outlier_score_iqr:6",
    f"""WITH {_FENCES}
SELECT event_id, value < low OR value > high AS is_outlier_iqr,
  CASE WHEN value < low THEN (low - value) / (q3 - q1) WHEN value > high THEN (value - high) / (q3 - q1) ELSE 0 END AS outlier_score_iqr
FROM events JOIN f USING (event_type)""",
)
def _iqr(spark, sf):
    return anomaly.iqr_outliers(_events(spark, sf), ["event_type"], "value", scale="rows")


@query(
    "outlier_zscore",
    "event_id:i is_outlier_zscore:b outlier_score_zscore:6",
    """WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1)
SELECT event_id, abs((value - m) / s) > 1.5 AS is_outlier_zscore, abs((value - m) / s) AS outlier_score_zscore FROM events JOIN s USING (event_type)""",
)
def _zscore(spark, sf):
    return anomaly.zscore_outliers(_events(spark, sf), ["event_type"], "value", scale="rows")


@query(
    "outlier_modified_zscore",
    "event_id:i is_outlier_modified_zscore:b outlier_score_modified_zscore:6",
    """WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1),
d AS (SELECT event_type, event_id, abs(value - m) AS d FROM events JOIN m USING (event_type)),
k AS (SELECT event_type, median(d) AS mad FROM d GROUP BY 1)
SELECT event_id, 0.6745 * d / mad > 3.5 AS is_outlier_modified_zscore, 0.6745 * d / mad AS outlier_score_modified_zscore
FROM d JOIN k USING (event_type)""",
)
def _modified(spark, sf):
    return anomaly.modified_zscore_outliers(_events(spark, sf), ["event_type"], "value", scale="rows")


@query("outlier_isolation", "event_id:i is_outlier_isolation:b outlier_score_isolation:6")
def _isolation(spark, sf):
    """One forest over all event rows; every row is scored."""
    return anomaly.isolation_outliers(_events(spark, sf), ["event_type"], ("event_id",), ("value",), scale="rows")


_SEASONAL = """sea AS (SELECT nation, ts, y, coalesce(CASE WHEN s > 0 THEN abs((y - m) / s) END, 0) AS seasonal_zscore FROM (
  SELECT *, CASE WHEN count(*) OVER k > 1 THEN avg(y) OVER k ELSE avg(y) OVER a END AS m,
    CASE WHEN count(*) OVER k > 1 THEN stddev_samp(y) OVER k ELSE stddev_samp(y) OVER a END AS s
  FROM nm WINDOW k AS (PARTITION BY nation, month(ts)), a AS (PARTITION BY nation)))"""


def _rolling(window: int) -> str:
    half = window // 2
    return f"""rol AS (SELECT nation, ts, coalesce(CASE WHEN count(y) OVER r = {window} THEN abs((y - avg(y) OVER r) / nullif(stddev_samp(y) OVER r, 0)) END, 0) AS rolling_zscore
  FROM nm WINDOW r AS (PARTITION BY nation ORDER BY ts ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING))"""


@query(
    "outlier_seasonal",
    "nation:i ts:d seasonal_zscore:6 is_outlier_seasonal:b",
    f"WITH {NATION_ALL}, {_SEASONAL} SELECT *, seasonal_zscore > 1.5 AS is_outlier_seasonal FROM sea",
)
def _seasonal(spark, sf):
    return anomaly.seasonal_outliers(panels.nation_monthly(spark, sf, closed=False), ["nation"], threshold=1.5)


@query(
    "outlier_rolling",
    "nation:i ts:d rolling_zscore:6 is_outlier_rolling:b",
    f"WITH {NATION_ALL}, {_rolling(7)} SELECT *, rolling_zscore > 2 AS is_outlier_rolling FROM rol",
)
def _rolling_query(spark, sf):
    return anomaly.rolling_outliers(panels.nation_monthly(spark, sf, closed=False), ["nation"], window=7)


_CONSENSUS = f"""{NATION_ALL}, {_SEASONAL}, {_rolling(5)},
fen AS (SELECT nation, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3, avg(y) AS m, stddev_pop(y) AS s FROM nm GROUP BY 1),
flags AS (SELECT nm.nation, nm.ts, nm.y,
    nm.y < q1 - 1.5 * (q3 - q1) OR nm.y > q3 + 1.5 * (q3 - q1) AS is_outlier_iqr,
    CASE WHEN nm.y < q1 - 1.5 * (q3 - q1) THEN (q1 - 1.5 * (q3 - q1) - nm.y) / (q3 - q1)
      WHEN nm.y > q3 + 1.5 * (q3 - q1) THEN (nm.y - q3 - 1.5 * (q3 - q1)) / (q3 - q1) ELSE 0 END AS outlier_score_iqr,
    abs((nm.y - m) / s) > 2.5 AS is_outlier_zscore, abs((nm.y - m) / s) AS outlier_score_zscore,
    seasonal_zscore, seasonal_zscore > 2.5 AS is_outlier_seasonal, rolling_zscore, rolling_zscore > 2 AS is_outlier_rolling
  FROM nm JOIN fen USING (nation) JOIN sea USING (nation, ts) JOIN rol USING (nation, ts)),
con AS (SELECT *, outlier_votes >= 2 AS is_outlier_consensus, (outlier_score_iqr + outlier_score_zscore) / 2 AS outlier_score_combined
  FROM (SELECT *, is_outlier_iqr::INT + is_outlier_zscore::INT + is_outlier_seasonal::INT + is_outlier_rolling::INT AS outlier_votes FROM flags))"""


def _consensus_frame(spark, sf):
    return anomaly.consensus_outliers(panels.nation_monthly(spark, sf, closed=False), ["nation"], isolation=False)


@query(
    "outlier_consensus_sql",
    "nation:i ts:d y:2 is_outlier_iqr:b outlier_score_iqr:6 is_outlier_zscore:b outlier_score_zscore:6 seasonal_zscore:6 "
    "is_outlier_seasonal:b rolling_zscore:6 is_outlier_rolling:b outlier_votes:i is_outlier_consensus:b outlier_score_combined:6",
    f"WITH {_CONSENSUS} SELECT * FROM con",
)
def _consensus_sql(spark, sf):
    return _consensus_frame(spark, sf)


@query(
    "outlier_consensus",
    "nation:i ts:d y:2 outlier_votes:i is_outlier_consensus:b outlier_score_isolation:6 outlier_score_combined:6",
)
def _consensus(spark, sf):
    """All five votes, with one isolation forest per series."""
    return anomaly.consensus_outliers(panels.nation_monthly(spark, sf, closed=False), ["nation"])


_METHODS = ("iqr", "zscore", "seasonal", "rolling", "consensus")


@query(
    "outlier_summary",
    "nation:i method:s n_outliers:i pct:2 total:i",
    f"WITH {_CONSENSUS}\n"
    + " UNION ALL ".join(
        f"SELECT nation, '{m}' AS method, count(*) FILTER (is_outlier_{m}) AS n_outliers, round(count(*) FILTER (is_outlier_{m}) * 100.0 / count(*), 2) AS pct, count(*) AS total FROM con GROUP BY nation"
        for m in _METHODS
    ),
)
def _summary(spark, sf):
    return anomaly.outlier_summary(_consensus_frame(spark, sf), ["nation"])


@query(
    "outlier_vote_histogram",
    "nation:i outlier_votes:i n:i",
    f"WITH {_CONSENSUS} SELECT nation, outlier_votes, count(*) AS n FROM con GROUP BY 1, 2",
)
def _histogram(spark, sf):
    return anomaly.vote_histogram(_consensus_frame(spark, sf), ["nation"])


@query(
    "outlier_consensus_dates", "nation:i ts:d", f"WITH {_CONSENSUS} SELECT nation, ts FROM con WHERE is_outlier_consensus"
)
def _dates(spark, sf):
    return anomaly.consensus_dates(_consensus_frame(spark, sf), ["nation"])


@query(
    "treat_remove", "nation:i ts:d y:2", f"WITH {_CONSENSUS} SELECT nation, ts, y FROM con WHERE NOT is_outlier_consensus"
)
def _remove(spark, sf):
    return anomaly.treat_outliers(_consensus_frame(spark, sf), "remove", ["nation"])


@query(
    "treat_interpolate",
    "nation:i ts:d y:4",
    f"""WITH {_CONSENSUS},
k AS (SELECT nation, ts, CASE WHEN NOT is_outlier_iqr THEN y END AS v FROM con),
b AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER p AS t0, last_value(v IGNORE NULLS) OVER p AS v0,
    first_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER n AS t1, first_value(v IGNORE NULLS) OVER n AS v1
  FROM k WINDOW p AS (PARTITION BY nation ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    n AS (PARTITION BY nation ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT nation, ts, coalesce(v, v0 + (v1 - v0) * (date_diff('day', t0, ts)::DOUBLE / nullif(date_diff('day', t0, t1), 0)), v0) AS y FROM b""",
)
def _interpolate(spark, sf):
    """Interpolates over the IQR flags, which mark more points than the consensus does."""
    return anomaly.interpolate_outliers(_consensus_frame(spark, sf), ["nation"], flag="is_outlier_iqr")


@query(
    "treat_winsorize",
    "event_id:i event_type:s value:4",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events GROUP BY 1)
SELECT event_id, event_type, least(greatest(value, lo), hi) AS value FROM events JOIN q USING (event_type)""",
)
def _winsorize(spark, sf):
    return anomaly.winsorize(_events(spark, sf), ["event_type"], "value", scale="rows")


@query(
    "anomaly_points",
    "nation:i ts:d y:2 is_anomaly:b anomaly_score:6",
    f"""WITH {NATION_ALL}, f AS (SELECT nation, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM nm GROUP BY 1),
l AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM f)
SELECT nm.nation, ts, y, y < low OR y > high AS is_anomaly,
  CASE WHEN y < low THEN (low - y) / (q3 - q1) WHEN y > high THEN (y - high) / (q3 - q1) ELSE 0 END AS anomaly_score
FROM nm JOIN l USING (nation)""",
)
def _points(spark, sf):
    return anomaly.anomaly_points(panels.nation_monthly(spark, sf, closed=False), "statistical", "high", ["nation"])


@query(
    "anomaly_patterns",
    "nation:i level:s month:i year:i n:i mean_value:6 min_value:2 max_value:2 std_value:4",
    f"""WITH {_CONSENSUS}
SELECT nation, CASE WHEN m IS NOT NULL THEN 'month' WHEN yr IS NOT NULL THEN 'year' ELSE 'all' END AS level, m AS month, yr AS year,
  count(*) AS n, avg(y) AS mean_value, min(y) AS min_value, max(y) AS max_value, stddev_samp(y) AS std_value
FROM (SELECT nation, month(ts) AS m, year(ts) AS yr, y FROM con WHERE is_outlier_iqr)
GROUP BY GROUPING SETS ((nation), (nation, m), (nation, yr))""",
)
def _patterns(spark, sf):
    return anomaly.anomaly_patterns(_consensus_frame(spark, sf), "is_outlier_iqr", ["nation"])


@query(
    "outlier_iqr_floor",
    "lang:s doc_id:i column_name:s value:2",
    """WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents),
q AS (SELECT lang, max(n_chars) FILTER (i = CAST(floor(n * 0.25) AS BIGINT)) AS q1, max(n_chars) FILTER (i = CAST(floor(n * 0.75) AS BIGINT)) AS q3 FROM r GROUP BY 1)
SELECT lang, doc_id, 'n_chars' AS column_name, n_chars AS value FROM documents JOIN q USING (lang)
WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1)""",
)
def _floor(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "doc_id", "n_chars")
    return anomaly.iqr_floor_outliers(docs, ["n_chars"], ["doc_id"], ["lang"])
