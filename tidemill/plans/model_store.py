"""Fit once, forecast later, fit on when rows arrive: models of a panel as tables.

A family is a kind of model with three verbs: ``train`` makes a table with one
row per series, ``predict`` forecasts from that table alone, at any horizon, and
``retrain`` makes the table of old and new rows together from the old table and
the new rows, without the old ones. Families whose fit is not a function of sums
(ARIMA, additive) have no ``retrain`` and are trained again on the whole panel.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import attach, ratio
from ..operators import additive, arima, ensemble, lagreg, scenario
from ..operators.trend import indexed
from ..session import settle

FORECAST = ("step", "ds", "yhat", "lower", "upper")


@dataclass(frozen=True)
class Family:
    """``facts`` name what the table says of a fit: rows used, parameters, AIC and status, as column expressions."""

    name: str
    train: Callable[[DataFrame, Sequence[str]], DataFrame]
    predict: Callable[[DataFrame, Sequence[str], int], DataFrame]
    retrain: Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame] | None = None
    facts: Mapping[str, Column] = field(default_factory=dict)


# ---- closed-form paths ----------------------------------------------------------------------

RECENT = 12


def path_train(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y") -> DataFrame:
    """(keys, n, last_ts, recent, sum_y, sum_iy, sum_yy): all that the closed-form paths need of a series."""
    state = lagreg.series_state(df, keys, ts, y, RECENT)
    return attach(state, _index_sums(indexed(df, keys, ts), keys, y), keys, "_s").select(*state.columns, "_s.sum_y", "_s.sum_iy", "_s.sum_yy")


def _index_sums(rows: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    value, i = F.col(y).cast("double"), F.col("idx").cast("double")
    return rows.groupBy(*keys).agg(F.sum(value).alias("sum_y"), F.sum(i * value).alias("sum_iy"), F.sum(value * value).alias("sum_yy"))


def path_retrain(models: DataFrame, new: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y") -> DataFrame:
    """The table of old and new rows together; new rows not after a series' last time are left out."""
    beside = attach(new, models.select(*keys, "n", "last_ts"), keys, "_old")
    fresh = beside.where(F.col("_old.last_ts").isNull() | (F.col(ts) > F.col("_old.last_ts")))
    rows = indexed(fresh, keys, ts).withColumn("idx", F.col("idx") + F.coalesce("_old.n", F.lit(0)))
    state = lagreg.merged_state(models, new, keys, ts, y, RECENT)
    held = attach(attach(state, models.select(*keys, "sum_y", "sum_iy", "sum_yy"), keys, "_o"), _index_sums(rows, keys, y), keys, "_n")
    sums = [(F.coalesce(f"_o.{c}", F.lit(0.0)) + F.coalesce(f"_n.{c}", F.lit(0.0))).alias(c) for c in ("sum_y", "sum_iy", "sum_yy")]
    return held.select(*state.columns, *sums)


def path_predict(name: str) -> Callable[[DataFrame, Sequence[str], int], DataFrame]:
    """One of the paths ``trend`` (line through all rows), ``recent_slope`` (from the last value on, by the slope of the last 12) and ``seasonal_path``."""

    def predict(models: DataFrame, keys: Sequence[str] = (), horizon: int = 12) -> DataFrame:
        n = F.col("n").cast("double")
        sum_i, sum_ii = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
        slope = ratio(n * F.col("sum_iy") - sum_i * F.col("sum_y"), n * sum_ii - sum_i * sum_i)
        near = F.col("recent.y")
        k = F.size(near).cast("double")
        total = F.aggregate(near, F.lit(0.0), lambda a, v: a + v)
        weighed = F.aggregate(F.transform(near, lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v)
        facts = models.select(
            *keys, "last_ts", n.alias("_n"), slope.alias("_slope"), ((F.col("sum_y") - slope * sum_i) / n).alias("_intercept"),
            F.try_element_at(near, F.lit(-1)).alias("_last"),
            ratio(k * weighed - (k * (k - 1) / 2) * total, k * ((k - 1) * k * (2 * k - 1) / 6) - (k * (k - 1) / 2) * (k * (k - 1) / 2)).alias("_slope12"),
        )
        steps = facts.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        step = F.col("step")
        value = {
            "trend": F.col("_intercept") + F.col("_slope") * (F.col("_n") - 1 + step),
            "recent_slope": F.col("_last") + step * F.col("_slope12"),
            "seasonal_path": F.col("_last") + step * F.col("_slope12") * scenario.season_factor(step, F.month("last_ts")),
        }[name]
        none = F.lit(None).cast("double")
        ds = F.last_day(F.add_months(F.trunc("last_ts", "month"), step))
        return steps.select(*keys, "step", ds.alias("ds"), value.alias("yhat"), none.alias("lower"), none.alias("upper"))

    return predict


def path_family(name: str) -> Family:
    none = F.lit(None).cast("double")
    facts = {"n_rows": F.col("n"), "n_parameters": F.lit(2), "aic": none, "status": F.when(F.col("n") > 1, "success").otherwise("short")}
    return Family(name, path_train, path_predict(name), path_retrain, facts)


# ---- fitted families ------------------------------------------------------------------------


def arima_family(name: str = "arima", **options) -> Family:
    facts = {"n_rows": F.col("n_eff"), "n_parameters": F.size("params") + F.size("beta") + 1, "aic": F.col("aic"), "status": F.col("status")}
    return Family(name, lambda df, keys: arima.arima_train(df, keys, **options), arima.arima_predict, None, facts)


def lag_family(name: str = "lag_regression", model: lagreg.LagRegression = lagreg.LagRegression("ridge")) -> Family:
    # Gaussian likelihood at the residuals' variance; a perfect or missing fit has none
    aic = F.when(F.col("resid_std") > 0, F.col("n_rows") * (F.log(F.pow("resid_std", F.lit(2))) + 1 + F.log(F.lit(2.0) * F.pi())) + 2 * (F.col("n_nonzero") + 2))
    facts = {"n_rows": F.coalesce("n_rows", F.lit(0)), "n_parameters": F.coalesce(F.col("n_nonzero") + 1, F.lit(0)), "aic": aic, "status": F.when(F.col("intercept").isNull(), "short").otherwise("success")}
    return Family(
        name,
        lambda df, keys: lagreg.lag_regression_train(df, keys, model=model),
        lagreg.lag_regression_predict,
        lambda models, new, keys: lagreg.lag_regression_retrain(models, new, keys, model=model),
        facts,
    )


def additive_family(name: str = "additive", config: additive.AdditiveConfig = additive.AdditiveConfig()) -> Family:
    facts = {"n_rows": F.col("n"), "n_parameters": F.size("coef") + 1, "aic": F.lit(None).cast("double"), "status": F.col("status")}
    return Family(name, lambda df, keys: additive.additive_train(df, keys, config), lambda models, keys, h: additive.additive_predict(models, keys, h, config), None, facts)


def families() -> dict[str, Family]:
    """The families with their default settings."""
    made = [*map(path_family, ("trend", "recent_slope", "seasonal_path")), arima_family(), lag_family(), additive_family()]
    return {f.name: f for f in made}


# ---- a panel's models -----------------------------------------------------------------------


@dataclass(frozen=True)
class TrainedPanel:
    """The model tables of a panel, by family; the panel itself is not needed any more."""

    keys: list[str]
    families: dict[str, Family]
    tables: dict[str, DataFrame]
    version: int = 1
    weights: DataFrame | None = None

    def forecast(self, horizon: int = 12) -> DataFrame:
        """(keys, model, step, ds, yhat, lower, upper, status) of all families."""
        out: DataFrame | None = None
        for name, table in self.tables.items():
            made = self.families[name].predict(table, self.keys, horizon)
            status = F.col("status") if "status" in made.columns else F.lit("success")
            rows = made.select(
                *self.keys, F.lit(name).alias("model"), F.col("step").cast("int").alias("step"), "ds", *[F.col(c).cast("double").alias(c) for c in ("yhat", "lower", "upper")], status.alias("status")
            )
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise ValueError("no families given")
        return out

    def combined(self, horizon: int = 12) -> DataFrame:
        """The forecasts put together by the weights, or evenly without any."""
        good = self.forecast(horizon).where("status = 'success'").drop("status")
        if self.weights is None:
            return ensemble.simple_average(good, self.keys)
        return ensemble.weighted_average(good, self.weights, self.keys, intervals=True)

    def info(self) -> DataFrame:
        """(keys, model, version, n_rows, last_ts, n_parameters, aic, status): what was fitted on how much."""
        out: DataFrame | None = None
        for name, table in self.tables.items():
            facts = self.families[name].facts
            rows = table.select(
                *self.keys, F.lit(name).alias("model"), F.lit(self.version).alias("version"), facts["n_rows"].cast("bigint").alias("n_rows"),
                F.to_date("last_ts").alias("last_ts"), facts["n_parameters"].cast("int").alias("n_parameters"), facts["aic"].cast("double").alias("aic"), facts["status"].alias("status"),
            )
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise ValueError("no families given")
        return out

    def retrain(self, new: DataFrame, whole: DataFrame | None = None) -> TrainedPanel:
        """The next version, on old and new rows. Families that cannot be fitted on need the ``whole`` panel.

        New rows not after a series' last time are left out.
        """
        tables = {}
        for name, table in self.tables.items():
            family = self.families[name]
            if family.retrain is not None:
                tables[name] = settle(family.retrain(table, new, self.keys))
            elif whole is not None:
                tables[name] = settle(family.train(whole, self.keys))
            else:
                raise ValueError(f"{name} is fitted on all rows at once; give the whole panel")
        return replace(self, tables=tables, version=self.version + 1)

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """Write the tables to a shared folder, one folder each, and what is known of all of them last."""
        for name, table in self.tables.items():
            table.write.mode(mode).parquet(f"{path}/{name}")
        if self.weights is not None:
            self.weights.write.mode(mode).parquet(f"{path}/panel-weights")
        spark = next(iter(self.tables.values())).sparkSession
        about = json.dumps({"keys": self.keys, "families": list(self.tables), "version": self.version, "weighted": self.weights is not None})
        spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode(mode).parquet(f"{path}/panel-about")

    @classmethod
    def load(cls, spark: SparkSession, path: str, known: Mapping[str, Family] | None = None) -> TrainedPanel:
        """Read saved tables; ``known`` gives the families if their settings are not the default ones."""
        about = json.loads(spark.read.parquet(f"{path}/panel-about").first().about)
        known = dict(known or families())
        missing = [n for n in about["families"] if n not in known]
        if missing:
            raise ValueError(f"families {missing} are not known here")
        tables = {n: spark.read.parquet(f"{path}/{n}") for n in about["families"]}
        weights = spark.read.parquet(f"{path}/panel-weights") if about["weighted"] else None
        return cls(about["keys"], {n: known[n] for n in tables}, tables, about["version"], weights)


def train(df: DataFrame, chosen: Mapping[str, Family] | None = None, keys: Sequence[str] = (), weights: DataFrame | None = None) -> TrainedPanel:
    """Fit every family to every series once. ``weights`` (keys, model, weight), as from a hold-out, are kept beside the tables."""
    df = settle(df)  # read by every family
    chosen = dict(chosen or families())
    return TrainedPanel(list(keys), chosen, {name: settle(f.train(df, keys)) for name, f in chosen.items()}, 1, weights)
