"""Feature engineering, correlation and selection queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from ..functions.columns import by_time, complete_rows
from ..operators import features, profile
from . import panels
from .panels import NATION_ALL
from .registry import query

_W = "(PARTITION BY nation ORDER BY ts)"


def lag_sql(lags: Sequence[int]) -> list[str]:
    return [f"lag(y, {k}) OVER w AS y_lag_{k}" for k in lags]


def frame_sql(fn: str, n: int, back: int = 0) -> str:
    frame = f"ROWS BETWEEN {n - 1 + back} PRECEDING AND {f'{back} PRECEDING' if back else 'CURRENT ROW'}"
    over = f"OVER (PARTITION BY nation ORDER BY ts {frame})"
    return f"CASE WHEN count(y) {over} = {n} THEN {fn}(y) {over} END"


def rolling_sql(stem: str, windows: Sequence[int], back: int = 0) -> list[str]:
    fns = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    return [f"{frame_sql(fn, n, back)} AS {stem}_{name}_{n}" for n in windows for name, fn in fns.items()]


def season_sql() -> list[str]:
    return [
        "year(ts) AS year",
        "month(ts) AS month",
        "quarter(ts) AS quarter",
        "dayofyear(ts) AS day_of_year",
        "weekofyear(ts) AS week_of_year",
        "sin(2 * pi() * month(ts) / 12) AS month_sin",
        "cos(2 * pi() * month(ts) / 12) AS month_cos",
        "sin(2 * pi() * quarter(ts) / 4) AS quarter_sin",
        "cos(2 * pi() * quarter(ts) / 4) AS quarter_cos",
        "CASE WHEN month(ts) IN (12, 1) THEN 1 ELSE 0 END AS is_holiday_season",
        "CASE WHEN month(ts) BETWEEN 6 AND 8 THEN 1 ELSE 0 END AS is_summer",
    ]


_GROWTH = "(y - lag(y) OVER w) / nullif(lag(y) OVER w, 0)"
_GROWTH_BEFORE = "(lag(y) OVER w - lag(y, 2) OVER w) / nullif(lag(y, 2) OVER w, 0)"


def trend_sql() -> list[str]:
    short, long = frame_sql("avg", 3), frame_sql("avg", 12)
    return [
        "row_number() OVER w - 1 AS linear_trend",
        f"{_GROWTH} AS growth_rate",
        f"{short} AS ma_short",
        f"{long} AS ma_long",
        f"CASE WHEN {short} > {long} THEN 1 ELSE 0 END AS trend_direction",
        f"{_GROWTH} - {_GROWTH_BEFORE} AS acceleration",
    ]


def statistical_sql() -> list[str]:
    spread = f"{frame_sql('stddev_samp', 12)} / nullif({frame_sql('avg', 12)}, 0)"
    whole = "OVER (PARTITION BY nation)"
    return [
        f"(y - avg(y) {whole}) / nullif(stddev_pop(y) {whole}, 0) AS y_zscore",
        f"(rank() OVER (PARTITION BY nation ORDER BY y) + (count(*) OVER (PARTITION BY nation, y) - 1) / 2.0) / count(*) {whole} AS y_percentile",
        f"abs(y - avg(y) {whole}) AS distance_from_mean",
        f"{spread} AS volatility",
        f"{spread} AS cv",
    ]


def model_sql(back: int) -> list[str]:
    now = f"lag(y, {back}) OVER w" if back else "y"
    before = f"lag(y, {back + 1}) OVER w"
    growth = f"({now} - {before}) / nullif({before}, 0)"
    short, long = frame_sql("avg", 3, back), frame_sql("avg", 12, back)
    idx = "(row_number() OVER w - 1)"
    season = [s for s in season_sql() if not s.endswith(("week_of_year", "is_summer", "is_holiday_season"))]
    return [
        *lag_sql(range(1, 13)),
        *rolling_sql("rolling", (3, 6, 12), back),
        *season,
        f"{idx} AS linear_trend",
        f"{idx} * {idx} AS quadratic_trend",
        f"{growth} AS growth_rate",
        f"{now} - {before} AS momentum",
        f"{short} / nullif({long}, 0) AS ma_ratio",
        f"{short} - {long} AS ma_diff",
        f"{frame_sql('stddev_samp', 12, back)} / nullif({long}, 0) AS volatility",
        "CASE WHEN quarter(ts) = 4 THEN 1 ELSE 0 END AS is_q4",
        "CASE WHEN month(ts) IN (12, 1) THEN 1 ELSE 0 END AS is_holiday_season",
        f"{idx} * month(ts) AS trend_month",
        f"{growth} * sin(2 * pi() * month(ts) / 12) AS growth_season",
    ]


def feature_cte(name: str, columns: Sequence[str], complete: bool) -> str:
    listed = ",\n  ".join(columns)
    keep = ""
    if complete:
        keep = " WHERE " + " AND ".join(f"{c.rsplit(' AS ', 1)[1]} IS NOT NULL" for c in columns)
    return f"""{name}_any AS (SELECT nation, ts, y,
  {listed}
  FROM nm WINDOW w AS {_W}),
{name} AS (SELECT * FROM {name}_any{keep})"""


def _names(columns: Sequence[str]) -> list[str]:
    return [c.rsplit(" AS ", 1)[1] for c in columns]


# Places each feature is compared to: whole numbers, ratios, levels.
def _kind(name: str) -> str:
    if name in ("year", "month", "quarter", "day_of_year", "week_of_year", "linear_trend", "quadratic_trend", "trend_month") or name.startswith(
        ("is_", "trend_direction")
    ):
        return "i"
    if "std" in name:
        return "4"
    return "6"


def _spec(columns: Sequence[str]) -> str:
    return "nation:i ts:d y:2 " + " ".join(f"{n}:{_kind(n)}" for n in _names(columns))


_LAGS = lag_sql((1, 2, 3, 6, 12))
_ROLL = rolling_sql("y_rolling", (3, 6, 12))
_TREND = trend_sql()
_STATS = statistical_sql()
_ALL = [*_LAGS, *_ROLL, *season_sql(), *_TREND, *_STATS]
_MODEL = model_sql(0)
_LAGGED = model_sql(1)


def _simple(name: str, columns: Sequence[str], complete: bool, fn) -> None:
    sql = f"WITH {NATION_ALL},\n{feature_cte('f', columns, complete)}\nSELECT * FROM f"

    @query(name, _spec(columns), sql)
    def _run(spark, sf):
        return fn(panels.nation_monthly(spark, sf, closed=False), ["nation"])


_simple("lag_features", _LAGS, False, features.lag_features)
_simple("rolling_features", _ROLL, False, features.rolling_features)
_simple("trend_features", _TREND, False, features.trend_features)
_simple("statistical_features", _STATS, False, features.statistical_features)
_simple("all_features", _ALL, True, features.all_features)
_simple("model_features", _MODEL, True, features.model_features)
_simple("model_features_lagged", _LAGGED, True, lambda df, keys: features.model_features(df, keys, lagged=True))


@query(
    "lookback_sequences",
    "nation:i ts:d target:2 recent:s",
    f"""WITH {NATION_ALL}, w AS (SELECT nation, ts, y AS target,
  list(CAST(CAST(y AS DECIMAL(18, 2)) AS VARCHAR)) OVER (PARTITION BY nation ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS items FROM nm)
SELECT nation, ts, target, array_to_string(items, ' ') AS recent FROM w WHERE len(items) = 12""",
)
def _sequences(spark, sf):
    rows = features.lookback_sequences(panels.nation_monthly(spark, sf, closed=False), ["nation"])
    texts = F.transform("window", lambda v: v.cast("decimal(18,2)").cast("string"))
    return rows.withColumn("recent", F.array_join(texts, " "))


def _scaled(method: str, expr: str) -> None:
    cols = ("y_lag_1", "linear_trend", "month")
    made = ", ".join(expr.replace("{c}", c) + f" AS {c}" for c in cols)
    base = [_LAGS[0], _TREND[0], "month(ts) AS month"]
    sql = f"WITH {NATION_ALL},\n{feature_cte('f', base, True)}\nSELECT nation, ts, y, {made} FROM f"

    @query(f"scale_{method}", "nation:i ts:d y:2 y_lag_1:6 linear_trend:6 month:6", sql)
    def _run(spark, sf):
        df = panels.nation_monthly(spark, sf, closed=False)
        w = by_time(["nation"])
        made = complete_rows(
            df.withColumns({"y_lag_1": F.lag("y").over(w), "linear_trend": F.row_number().over(w) - 1, "month": F.month("ts")})
        )
        return features.scale_features(made, method, "y", ["nation"], cols)


_scaled("standard", "({c} - avg({c}) OVER (PARTITION BY nation)) / stddev_pop({c}) OVER (PARTITION BY nation)")
_scaled(
    "minmax",
    "({c} - min({c}) OVER (PARTITION BY nation)) / CAST(max({c}) OVER (PARTITION BY nation) - min({c}) OVER (PARTITION BY nation) AS DOUBLE)",
)


@query(
    "interaction_features",
    'nation:i ts:d first_second:2 first_month:2 second_month:2 all_three:2',
    f"""WITH {NATION_ALL}, f AS (SELECT nation, ts, y / 1000000 AS y, lag(y / 1000000) OVER {_W} AS before, month(ts) AS month FROM nm)
SELECT nation, ts, y * before AS first_second, y * month AS first_month, before * month AS second_month,
  y * before * month AS all_three FROM f WHERE before IS NOT NULL""",
)
def _interactions(spark, sf):
    df = panels.nation_monthly(spark, sf, closed=False).withColumn("y", F.col("y") / 1000000)
    df = complete_rows(df.withColumns({"before": F.lag("y").over(by_time(["nation"])), "month": F.month("ts")}))
    out = features.interaction_features(df, ["y", "before", "month"], 3)
    renamed = {"y before": "first_second", "y month": "first_month", "before month": "second_month", "y before month": "all_three"}
    return out.withColumnsRenamed(renamed)


def corr_sql(a: str, b: str) -> str:
    """Correlation, null (not NaN) where a side does not vary."""
    c = f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
    return f"CASE WHEN isfinite({c}) THEN {c} END"


def _importance_sql(columns: Sequence[str], source: str = "f") -> str:
    parts = [
        f"SELECT nation, '{n}' AS feature, abs({corr_sql(n, 'y')}) AS importance FROM {source} GROUP BY nation"
        for n in _names(columns)
    ]
    return " UNION ALL ".join(parts)


_RANKED = "row_number() OVER (PARTITION BY nation ORDER BY round(importance, 9) DESC NULLS LAST, feature) AS rank"
_ALL_F = f"{NATION_ALL},\n{feature_cte('f_once', _ALL, True)},\nf AS MATERIALIZED (SELECT * FROM f_once)"
_LAGGED_F = f"{NATION_ALL},\n{feature_cte('f_once', _LAGGED, True)},\nf AS MATERIALIZED (SELECT * FROM f_once)"


@query(
    "feature_importance",
    "nation:i feature:s importance:6",
    f"WITH {_ALL_F}\n{_importance_sql(_ALL)}",
)
def _importance(spark, sf):
    return profile.feature_importance(features.all_features(panels.nation_monthly(spark, sf, closed=False), ["nation"]), "y", ["nation"])


@query(
    "top_k_features",
    "nation:i feature:s importance:6 rank:i",
    f"WITH {_ALL_F},\ni AS ({_importance_sql(_ALL)})\nSELECT * FROM (SELECT *, {_RANKED} FROM i) WHERE rank <= 20",
)
def _top_k(spark, sf):
    return profile.top_k_features(features.all_features(panels.nation_monthly(spark, sf, closed=False), ["nation"]), "y", 20, ["nation"])


def _families_sql() -> str:
    cases = []
    for label, words in profile.FEATURE_FAMILIES.items():
        hit = " OR ".join(f"contains(feature, '{w}')" for w in words)
        cases.append(f"CASE WHEN {hit} THEN '{label}' END")
    return f"concat_ws(',', {', '.join(cases)})"


@query(
    "correlation_report",
    "nation:i feature:s importance:6 rank:i families:s strength:s",
    f"""WITH {_ALL_F},
i AS ({_importance_sql(_ALL)}),
r AS (SELECT * FROM (SELECT *, {_RANKED} FROM i) WHERE rank <= 15)
SELECT *, {_families_sql()} AS families,
  CASE WHEN importance > 0.7 THEN 'strong' WHEN importance < 0.3 THEN 'weak' ELSE 'medium' END AS strength FROM r""",
)
def _correlations(spark, sf):
    found = profile.correlation_report(features.all_features(panels.nation_monthly(spark, sf, closed=False), ["nation"]), "y", 15, ["nation"])
    return found.withColumn("families", F.concat_ws(",", "families"))


_MATRIX = ("y", "y_lag_1", "y_lag_12", "y_rolling_mean_3", "y_rolling_std_12", "growth_rate", "month_sin", "linear_trend", "distance_from_mean", "volatility", "y_percentile")


@query(
    "correlation_matrix",
    "nation:i left:s right:s corr:6",
    f"WITH {_ALL_F}\n"
    + " UNION ALL ".join(
        f"""SELECT nation, '{a}' AS "left", '{b}' AS "right", {corr_sql(a, b)} AS corr FROM f GROUP BY nation"""
        for a in _MATRIX
        for b in _MATRIX
    ),
)
def _matrix(spark, sf):
    return profile.correlation_matrix(features.all_features(panels.nation_monthly(spark, sf, closed=False), ["nation"]), _MATRIX, ["nation"])


@query(
    "select_k_best",
    "nation:i feature:s importance:6 rank:i f_score:4",
    f"""WITH {_LAGGED_F},
i AS ({_importance_sql(_LAGGED)}),
s AS (SELECT nation, count(*) AS n FROM f GROUP BY 1)
SELECT r.*, importance * importance * (n - 2) / (1 - importance * importance) AS f_score
FROM (SELECT *, {_RANKED} FROM i) r JOIN s USING (nation) WHERE rank <= 15""",
)
def _k_best(spark, sf):
    made = features.model_features(panels.nation_monthly(spark, sf, closed=False), ["nation"], lagged=True)
    return features.select_k_best(made, "y", 15, ["nation"])
