"""Additive trend + seasonality + holiday model over panels.

Regressor columns (trend hinges, Fourier terms, holiday counts) are made by
Spark for history and future alike; each series then needs one small penalised
least-squares solve, done in its group. Penalties are the inverse prior
variances of the coefficients. Changepoint shrinkage is quadratic, so deltas are
small rather than exactly zero. Seasonal terms faster than two periods of the
calendar cannot be told from slower ones in the data and are left out by default,
since they would fit noise and extrapolate wildly.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import attach, per_series, period_end, spread
from . import gram
from .calendar_effects import SEASONALITIES, epoch_days, fourier_columns, hinge_positions, holiday_regressors
from .packing import key_fields
from .resample import future_calendar
from .trend import component_shares


# Mean length of a period in days.
STEP_DAYS = {"D": 1.0, "W": 7.0, "M": 30.4375, "Q": 91.3125, "Y": 365.25}


@dataclass(frozen=True)
class AdditiveConfig:
    """Settings with the usual defaults; ``extra`` seasonalities are used from ``extra_rows`` rows on."""

    yearly: bool = True
    weekly: bool = False
    extra: Mapping[str, tuple[float, int]] = field(
        default_factory=lambda: {n: SEASONALITIES[n] for n in ("monthly", "quarterly")}
    )
    extra_rows: int = 24
    changepoints: int = 25
    changepoint_scale: float = 0.05
    seasonality_scale: float = 10.0
    holidays_scale: float = 10.0
    mode: str = "additive"
    level: float = 0.95
    freq: str = "M"
    resolvable_only: bool = True

    def usable_order(self, period: float, order: int) -> int:
        """How many harmonics of a season to use."""
        if not self.resolvable_only:
            return order
        return min(order, int(period / (2 * STEP_DAYS[self.freq])))

    def seasonalities(self) -> dict[str, tuple[float, int]]:
        out = {"yearly": SEASONALITIES["yearly"]} if self.yearly else {}
        if self.weekly:
            out["weekly"] = SEASONALITIES["weekly"]
        return out | dict(self.extra)


def _terms(config: AdditiveConfig, holiday_names: Sequence[str] = ()) -> tuple[list[Column], list[str], list[str]]:
    """Regressors out of ``_t`` (0 to 1 over the history), ``_end`` and the holiday columns; their names and components."""
    hinges = [F.greatest(F.col("_t") - c, F.lit(0.0)) for c in hinge_positions(config.changepoints)]
    terms = ["intercept", "slope", *[f"hinge_{i + 1}" for i in range(config.changepoints)]]
    parts = ["trend"] * len(terms)
    columns = [F.lit(1.0), F.col("_t"), *hinges]
    for name, (period, order) in config.seasonalities().items():
        waves = fourier_columns("_end", {name: (period, config.usable_order(period, order))})
        terms += list(waves)
        parts += [name] * len(waves)
        columns += list(waves.values())
    return columns + [F.col(f"holiday_{n}") for n in holiday_names], terms + [f"holiday_{n}" for n in holiday_names], parts + ["holidays"] * len(holiday_names)


def _design(
    df: DataFrame, keys: Sequence[str], horizon: int, config: AdditiveConfig, holidays: DataFrame | None, names: Sequence[str]
) -> tuple[DataFrame, list[str], list[str]]:
    """History and future rows with array ``x``; the terms of ``x``, and each term's component."""
    past = df.select(*keys, F.to_date("ts").alias("ts"), "y", F.lit(0).alias("step"))
    if horizon:
        ahead = future_calendar(past, horizon, keys, freq=config.freq)
        past = past.unionByName(
            ahead.select(*keys, F.col("ds").alias("ts"), F.lit(None).cast("double").alias("y"), F.col("step").cast("int"))
        )
    # seasons are read at the period's end, so labels at its start or end mean the same period
    past = past.withColumn("_end", period_end("ts", config.freq))
    day, whole = epoch_days("_end"), per_series(keys)
    known = F.when(F.col("step") == 0, day)
    first, last = F.min(known).over(whole), F.max(known).over(whole)
    timed = past.withColumn("_t", (day - first) / F.greatest(last - first, F.lit(1)))
    used = list(names) if holidays is not None else []
    if used:
        timed = holiday_regressors(timed, holidays, used, "_end", freq=config.freq)
    columns, terms, parts = _terms(config, used)
    return timed.select(*keys, "ts", "y", "step", F.array(*columns).alias("x")), terms, parts


def solve(x: np.ndarray, y: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, float]:
    """(coefficients, noise std): penalised least squares, the noise level re-estimated from the fit."""
    sigma = 0.1
    beta = np.zeros(x.shape[1])
    for _ in range(5):
        beta = np.linalg.solve(x.T @ x + np.diag(sigma**2 / prior**2), x.T @ y)
        sigma = max(float(np.sqrt(np.mean((y - x @ beta) ** 2))), 1e-4)
    return beta, sigma


def _group_fit(terms: Sequence[str], parts: Sequence[str], config: AdditiveConfig):
    """A function (pdf) -> (pdf sorted, x, beta, sigma, scale, used) shared by the fit and coefficient jobs."""
    scales = {"trend": 5.0, "holidays": config.holidays_scale}
    prior = np.array(
        [config.changepoint_scale if t.startswith("hinge") else scales.get(p, config.seasonality_scale) for t, p in zip(terms, parts)]
    )
    optional = np.array([p in config.extra for p in parts])

    def fit(pdf: pd.DataFrame):
        pdf = pdf.sort_values(["step", "ts"])
        x = np.vstack(pdf["x"].to_numpy()).astype(float)
        raw = pdf["y"].to_numpy(dtype=float)
        if config.mode == "multiplicative":
            raw = np.log(np.where(raw > 0, raw, np.nan))
        train = np.isfinite(raw)
        used = ~optional if train.sum() < config.extra_rows else np.ones(len(terms), dtype=bool)
        scale = float(np.nanmax(np.abs(raw))) if train.any() else 1.0
        scale = scale or 1.0
        beta = np.zeros(len(terms))
        sigma = 0.0
        if train.sum() >= 2:
            beta[used], sigma = solve(x[train][:, used], raw[train] / scale, prior[used])
        return pdf, x, beta, sigma, scale

    return fit


def additive_fit(
    df: DataFrame,
    keys: Sequence[str] = (),
    horizon: int = 12,
    config: AdditiveConfig = AdditiveConfig(),
    holidays: DataFrame | None = None,
    holiday_names: Sequence[str] = (),
) -> DataFrame:
    """(keys, ts, step, y, yhat, lower, upper, one column per component): in-sample rows have step 0.

    In multiplicative mode the model is fitted to log y, and components are factors.
    """
    rows, terms, parts = _design(df, keys, horizon, config, holidays, holiday_names)
    fit = _group_fit(terms, parts, config)
    components = list(dict.fromkeys(["trend", *config.seasonalities(), *parts]))
    z = NormalDist().inv_cdf(0.5 + config.level / 2)
    names = list(keys)
    multiplicative = config.mode == "multiplicative"
    members = {c: np.array([p == c for p in parts]) for c in components}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x, beta, sigma, scale = fit(pdf)
        yhat = x @ beta * scale
        half = z * sigma * scale
        out = pdf[[*names, "ts", "step", "y"]].assign(yhat=yhat, lower=yhat - half, upper=yhat + half)
        for c in components:
            out[c] = x[:, members[c]] @ beta[members[c]] * scale
        if multiplicative:
            changed = ["yhat", "lower", "upper", *components]
            out[changed] = np.exp(out[changed])
        return out

    fields = key_fields(rows, keys) + [rows.schema["ts"], rows.schema["step"], rows.schema["y"]]
    fields += [T.StructField(c, T.DoubleType()) for c in ("yhat", "lower", "upper", *components)]
    return spread(rows, *keys).groupBy(*keys).applyInPandas(run, T.StructType(fields))


def additive_forecast(df: DataFrame, keys: Sequence[str] = (), horizon: int = 12, **options) -> DataFrame:
    """(keys, step, ds, yhat, lower, upper) of the next periods."""
    fitted = additive_fit(df, keys, horizon, **options)
    return fitted.where(F.col("step") > 0).select(*keys, "step", F.col("ts").alias("ds"), "yhat", "lower", "upper")


def additive_train(
    df: DataFrame,
    keys: Sequence[str] = (),
    config: AdditiveConfig = AdditiveConfig(),
    holidays: DataFrame | None = None,
    holiday_names: Sequence[str] = (),
) -> DataFrame:
    """The model table: (keys, n, first_day, last_day, last_ts, terms, coef, scale, noise, status), one row per series."""
    rows, terms, parts = _design(df, keys, 0, config, holidays, holiday_names)
    fit = _group_fit(terms, parts, config)
    names = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, _, beta, sigma, scale = fit(pdf)
        n = int(pdf["y"].notna().sum())
        made = {"n": n, "terms": list(terms), "coef": beta, "scale": scale, "noise": sigma, "status": "success" if n >= 2 else "short"}
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in names}, **made}])

    fields = key_fields(rows, keys) + [T.StructField("n", T.IntegerType()), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("coef", T.ArrayType(T.DoubleType()))]
    fields += [T.StructField(c, T.DoubleType()) for c in ("scale", "noise")] + [T.StructField("status", T.StringType())]
    models = spread(rows, *keys).groupBy(*keys).applyInPandas(run, T.StructType(fields))
    day = epoch_days(period_end("ts", config.freq))
    span = df.groupBy(*keys).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.max(F.to_date("ts")).alias("last_ts"))
    held = attach(models, span, keys, "_s")
    return held.select(*keys, "n", "_s.first_day", "_s.last_day", "_s.last_ts", "terms", "coef", "scale", "noise", "status")


def additive_predict(
    models: DataFrame,
    keys: Sequence[str] = (),
    horizon: int = 12,
    config: AdditiveConfig = AdditiveConfig(),
    holidays: DataFrame | None = None,
    holiday_names: Sequence[str] = (),
) -> DataFrame:
    """(keys, step, ds, yhat, lower, upper) from a model table alone, made with the same ``config``: no row of the panel and no Python."""
    ahead = future_calendar(models.withColumnRenamed("last_ts", "ts").select(*keys, "ts"), horizon, keys, freq=config.freq)
    beside = attach(ahead, models.select(*keys, "first_day", "last_day", "coef", "scale", "noise"), keys, "_m").withColumn("_end", period_end("ds", config.freq))
    beside = beside.withColumn("_t", (epoch_days("_end") - F.col("_m.first_day")) / F.greatest(F.col("_m.last_day") - F.col("_m.first_day"), F.lit(1)))
    used = list(holiday_names) if holidays is not None else []
    if used:
        beside = holiday_regressors(beside, holidays, used, "_end", freq=config.freq)
    columns, _, _ = _terms(config, used)
    products = F.zip_with(F.array(*[c.cast("double") for c in columns]), "_m.coef", lambda x, b: x * b)
    value = F.aggregate(products, F.lit(0.0), lambda a, b: a + b) * F.col("_m.scale")
    half = NormalDist().inv_cdf(0.5 + config.level / 2) * F.col("_m.noise") * F.col("_m.scale")
    shown = F.exp if config.mode == "multiplicative" else (lambda c: c)
    out = beside.withColumns({"_value": value, "_half": half})
    return out.select(
        *keys, F.col("step").cast("int").alias("step"), "ds", shown(F.col("_value")).alias("yhat"), shown(F.col("_value") - F.col("_half")).alias("lower"), shown(F.col("_value") + F.col("_half")).alias("upper")
    )


def changepoints(df: DataFrame, keys: Sequence[str] = (), config: AdditiveConfig = AdditiveConfig(), factor: float = 1.5) -> DataFrame:
    """(keys, changepoint, position, delta, significant): slope changes, significant beyond factor * population std.

    Approximate: see the note on shrinkage above.
    """
    rows, terms, parts = _design(df, keys, 0, config, None, ())
    fit = _group_fit(terms, parts, config)
    hinge = [i for i, t in enumerate(terms) if t.startswith("hinge")]
    spots = hinge_positions(config.changepoints)
    names = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, _, beta, _, scale = fit(pdf)
        days = pd.to_datetime(pdf["ts"])
        first, span = days.min(), (days.max() - days.min()).days
        at = [first + pd.Timedelta(days=int(round(span * s))) for s in spots]
        out = pd.DataFrame({"changepoint": [a.date() for a in at], "position": spots, "delta": beta[hinge] * scale})
        return out.assign(**{k: pdf[k].iloc[0] for k in names})

    fields = key_fields(rows, keys) + [T.StructField("changepoint", T.DateType())]
    fields += [T.StructField(c, T.DoubleType()) for c in ("position", "delta")]
    found = spread(rows, *keys).groupBy(*keys).applyInPandas(run, T.StructType(fields))
    limit = F.stddev_pop("delta").over(per_series(keys)) * factor
    return found.withColumn("significant", F.abs("delta") > limit)


def sparse_changepoints(df: DataFrame, keys: Sequence[str] = (), config: AdditiveConfig = AdditiveConfig()) -> DataFrame:
    """(keys, changepoint, position, delta, selected): where the slope of each series changes, and by how much per span of the history.

    The slope changes are chosen by an L1 path (:class:`.gram.Sparse`), so they
    are exactly 0 where the series does not bend. The regressors' sums of
    products are made in the JVM; no row of a series is looked at by Python. All
    places are put out, ``selected`` where there is a change. Seasons are those
    of ``config``. Rows without a value take no part; in multiplicative mode
    the model is of log y, and rows that are not positive take no part.
    """
    rows, terms, _ = _design(df, keys, 0, config, None, ())
    value = F.when(F.col("y") > 0, F.log("y")) if config.mode == "multiplicative" else F.col("y").cast("double")
    sums = gram.gram_sums(rows.withColumn("y", value), keys, "x", "y", len(terms))
    hinges = [i for i, t in enumerate(terms) if t.startswith("hinge")]
    others = [i for i, t in enumerate(terms) if i not in hinges and t != "intercept"]
    names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[names].assign(deltas=[gram.Sparse(g, hinges, others).best() for g in pdf["gram"]])

    found = spread(sums, *keys).mapInPandas(run, T.StructType(key_fields(sums, keys) + [T.StructField("deltas", T.ArrayType(T.DoubleType()))]))
    day = epoch_days(period_end("ts", config.freq))
    span = df.groupBy(*keys).agg(F.min(day).alias("first"), F.max(day).alias("last"))
    places = F.array(*[F.lit(float(p)) for p in hinge_positions(config.changepoints)])
    placed = attach(found, span, keys, "_s").select(*keys, "_s", F.posexplode(F.arrays_zip(places.alias("position"), F.col("deltas").alias("delta"))).alias("_i", "_d"))
    at = F.date_from_unix_date((F.col("_s.first") + F.round(F.col("_d.position") * (F.col("_s.last") - F.col("_s.first")))).cast("int"))
    return placed.select(*keys, at.alias("changepoint"), F.col("_d.position").alias("position"), F.col("_d.delta").alias("delta"), (F.col("_d.delta") != 0).alias("selected"))


def additive_importance(df: DataFrame, keys: Sequence[str] = (), config: AdditiveConfig = AdditiveConfig()) -> DataFrame:
    """Share of each component in the total variance of the in-sample components."""
    fitted = additive_fit(df, keys, 0, config)
    known = {*keys, "ts", "step", "y", "yhat", "lower", "upper"}
    return component_shares(fitted, [c for c in fitted.columns if c not in known], keys)
