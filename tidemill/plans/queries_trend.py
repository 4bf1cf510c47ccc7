"""Trend, decomposition, KPI and scenario queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scenario, trend
from . import panels
from .panels import FLAG_ALL, NATION_ALL, NATION_M, ORDERS_M
from .registry import query

_IDX = "idx AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY nation) AS n FROM nm)"


@query(
    "linear_trend",
    "nation:i ts:d y:2 idx:i slope:4 intercept:2 trend_line:2 interpretation:s",
    f"""WITH {NATION_ALL}, {_IDX}, s AS (SELECT nation, regr_slope(y, i) AS slope, regr_intercept(y, i) AS intercept FROM idx GROUP BY 1)
SELECT idx.nation, ts, y, i AS idx, slope, intercept, intercept + slope * i AS trend_line,
  CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'stable' END AS interpretation FROM idx JOIN s USING (nation)""",
)
def _linear(spark, sf):
    return trend.linear_trend(panels.nation_monthly(spark, sf, closed=False), ["nation"])


@query(
    "growth_rates",
    "nation:i n_growth:i mean_growth:6 std_growth:6 recent_3:6 recent_12:6",
    f"""WITH {NATION_ALL},
g AS (SELECT nation, ts, (y - lag(y) OVER w) / nullif(lag(y) OVER w, 0) AS g FROM nm WINDOW w AS (PARTITION BY nation ORDER BY ts)),
r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY ts DESC) AS b FROM g WHERE g IS NOT NULL)
SELECT nation, count(*) AS n_growth, avg(g) AS mean_growth, stddev_samp(g) AS std_growth, avg(g) FILTER (b <= 3) AS recent_3,
  CASE WHEN count(*) >= 12 THEN avg(g) FILTER (b <= 12) END AS recent_12 FROM r GROUP BY 1""",
)
def _growth(spark, sf):
    return trend.growth_rates(panels.nation_monthly(spark, sf, closed=False), ["nation"])


def _decomposition_sql(model: str) -> str:
    rest, center, residual = {
        "additive": ("y - trend", "m - avg(m) OVER a", "y - trend - seasonal"),
        "multiplicative": ("y / nullif(trend, 0)", "m / avg(m) OVER a", "y / nullif(trend * seasonal, 0)"),
    }[model]
    return f"""WITH {FLAG_ALL},
t AS (SELECT flag, status, ts, y, (row_number() OVER w - 1) % 12 AS pos,
    CASE WHEN count(y) OVER (PARTITION BY flag, status ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13
      AND count(*) OVER (PARTITION BY flag, status) >= 24
    THEN (sum(y) OVER (PARTITION BY flag, status ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
      + 0.5 * (lag(y, 6) OVER w + lead(y, 6) OVER w)) / 12 END AS trend
  FROM fm WINDOW w AS (PARTITION BY flag, status ORDER BY ts)),
p AS (SELECT flag, status, pos, avg({rest}) AS m FROM t GROUP BY 1, 2, 3),
c AS (SELECT flag, status, pos, {center} AS seasonal FROM p WINDOW a AS (PARTITION BY flag, status))
SELECT flag, status, ts, y AS observed, trend, seasonal, {residual} AS residual FROM t JOIN c USING (flag, status, pos)"""


def _decomposition(model: str, places: int) -> None:
    @query(
        f"decompose_{model}",
        f"flag:s status:s ts:d observed:4 trend:2 seasonal:{places} residual:{places}",
        _decomposition_sql(model),
    )
    def _run(spark, sf):
        return trend.decompose(panels.flag_monthly(spark, sf, closed=False), ["flag", "status"], model=model)


_decomposition("additive", 2)
_decomposition("multiplicative", 6)


@query(
    "component_importance",
    "flag:s status:s component:s variance:0 importance:6",
    f"""WITH d AS ({_decomposition_sql('additive')}),
v AS (SELECT flag, status, 'trend' AS component, var_samp(trend) AS variance FROM d GROUP BY ALL
  UNION ALL SELECT flag, status, 'seasonal', var_samp(seasonal) FROM d GROUP BY ALL)
SELECT *, variance * 100.0 / sum(variance) OVER (PARTITION BY flag, status) AS importance FROM v""",
)
def _components(spark, sf):
    parts = trend.decompose(panels.flag_monthly(spark, sf, closed=False), ["flag", "status"])
    return trend.component_shares(parts, ["trend", "seasonal"], ["flag", "status"])


def kpi_sql(source: str, key: str | None) -> str:
    k = f"{key}, " if key else ""
    part = f"PARTITION BY {key} " if key else ""
    group = f" GROUP BY {key}" if key else ""
    return f"""b AS (SELECT *, row_number() OVER ({part}ORDER BY ts DESC) AS b FROM {source}),
f AS (SELECT {k}count(*) AS total_periods, min(ts) AS start_ts, max(ts) AS end_ts, max(y) FILTER (b = 1) AS current_value,
    coalesce(max(y) FILTER (b = 2), max(y) FILTER (b = 1)) AS previous_value, max(y) FILTER (b = 13) AS year_ago, avg(y) AS avg_value,
    regr_slope(y, -b) FILTER (b <= 6) AS recent_slope, stddev_samp(y) * 100 / nullif(avg(y), 0) AS volatility FROM b{group}),
g AS (SELECT *, (current_value - previous_value) / nullif(previous_value, 0) * 100 AS mom_growth,
    (current_value - year_ago) / nullif(year_ago, 0) * 100 AS yoy_growth, greatest(70, 100 - abs(volatility) / 2) AS forecast_accuracy FROM f)
SELECT *, CASE WHEN recent_slope > 0 THEN 'increasing' WHEN recent_slope < 0 THEN 'decreasing' ELSE 'stable' END AS trend_direction,
  CASE WHEN mom_growth > 0 THEN 'up' WHEN mom_growth < 0 THEN 'down' ELSE 'neutral' END AS mom_trend,
  CASE WHEN yoy_growth > 0 THEN 'up' WHEN yoy_growth < 0 THEN 'down' ELSE 'neutral' END AS yoy_trend,
  CASE WHEN volatility > 20 THEN 'high' WHEN volatility > 10 THEN 'medium' ELSE 'low' END AS volatility_level,
  CASE WHEN forecast_accuracy > 90 THEN 'excellent' WHEN forecast_accuracy > 80 THEN 'good' ELSE 'fair' END AS accuracy_level FROM g"""


KPI_SPEC = (
    "total_periods:i start_ts:d end_ts:d current_value:2 previous_value:2 avg_value:6 recent_slope:4 volatility:6 mom_growth:6 "
    "yoy_growth:6 forecast_accuracy:6 trend_direction:s mom_trend:s yoy_trend:s volatility_level:s accuracy_level:s"
)


@query("kpis", KPI_SPEC, f"WITH {ORDERS_M}, {kpi_sql('om', None)}")
def _kpis(spark, sf):
    return trend.kpis(panels.orders_monthly(spark, sf))


@query("kpis_by_part", "part:i " + KPI_SPEC.replace("current_value:2 previous_value:2 avg_value:6", "current_value:4 previous_value:4 avg_value:0"), f"WITH {panels.PART_M}, {kpi_sql('ptm', 'part')}")
def _kpis_part(spark, sf):
    return trend.kpis(panels.part_monthly(spark, sf), ["part"])


_PATH = f"""{NATION_M}, {_IDX},
pf AS (SELECT nation, max(ts) AS last_ts, arg_max(y, ts) AS last_value, regr_slope(y, i) FILTER (i >= n - 12) AS slope FROM idx GROUP BY 1),
path AS (SELECT nation, step, last_day(date_trunc('month', last_ts) + to_months(CAST(step AS INTEGER))) AS ds, last_value, slope,
    last_value + step * slope * (1 + 0.1 * sin(2 * pi() * (step - 1 + month(last_ts)) / 12)) AS base FROM pf, range(1, 13) AS r(step))"""


def _path(spark, sf):
    return scenario.base_path(panels.nation_monthly(spark, sf), ["nation"])


@query("scenario_base", "nation:i step:i ds:d base:2", f"WITH {_PATH} SELECT * FROM path")
def _base(spark, sf):
    return _path(spark, sf)


_SCENARIOS = {
    "growth": ("base * (1 + 0.1 * step / 12)", lambda p: scenario.scenario(p, "growth_rate", percent=10.0)),
    "seasonal": (
        "CASE WHEN month(ds) IN (11, 12) THEN base * 1.15 ELSE base END",
        lambda p: scenario.scenario(p, "seasonal_adjustment", percent=15.0),
    ),
    "trend": ("last_value + step * 5000.0", lambda p: scenario.scenario(p, "trend_change", slope=5000.0)),
}


def _scenario(name: str, expr: str, fn) -> None:
    @query(
        f"scenario_{name}",
        "nation:i step:i ds:d base:2 scenario:2 difference:2",
        f"WITH {_PATH}, s AS (SELECT *, {expr} AS scenario FROM path) SELECT *, scenario - base AS difference FROM s",
    )
    def _run(spark, sf):
        return scenario.monthly_differences(fn(_path(spark, sf)))


for _name, (_expr, _fn) in _SCENARIOS.items():
    _scenario(_name, _expr, _fn)


@query(
    "scenario_impact",
    "nation:i total_base:2 total_scenario:2 absolute_impact:2 percentage_impact:6 direction:s recommendation:s",
    f"""WITH {_PATH}, s AS (SELECT nation, sum(base) AS total_base, sum({_SCENARIOS['growth'][0]}) AS total_scenario FROM path GROUP BY 1),
p AS (SELECT *, total_scenario - total_base AS absolute_impact, (total_scenario - total_base) * 100 / nullif(total_base, 0) AS percentage_impact FROM s)
SELECT *, CASE WHEN percentage_impact > 0 THEN 'Positive' ELSE 'Negative' END AS direction,
  CASE WHEN percentage_impact > 5 THEN 'Favorable scenario' WHEN abs(percentage_impact) <= 5 THEN 'Neutral impact' ELSE 'Challenging scenario' END AS recommendation FROM p""",
)
def _impact(spark, sf):
    return scenario.scenario_impact(_SCENARIOS["growth"][1](_path(spark, sf)), ["nation"])


@query(
    "forecast_summary",
    "nation:i first_value:4 last_value:4 growth_rate:1 risk_level:s",
    f"""WITH {_PATH}, e AS (SELECT nation, round(arg_min(base, step), 4) AS first_value, round(arg_max(base, step), 4) AS last_value FROM path GROUP BY 1),
g AS (SELECT *, round((last_value - first_value) / nullif(first_value, 0) * 100, 1) AS growth_rate FROM e)
SELECT *, CASE WHEN abs(growth_rate) > 20 THEN 'High' WHEN abs(growth_rate) > 10 THEN 'Medium' ELSE 'Low' END AS risk_level FROM g""",
)
def _forecast_summary(spark, sf):
    path = _path(spark, sf).withColumn("yhat", F.round("base", 4))
    return trend.forecast_summary(path, ["nation"])
