"""Seasonal ARIMA over panels: fits, order search and forecasts, parallel by series and differencing.

Coefficients minimise the conditional sum of squares (pre-sample values 0).
All candidate orders that share a differencing are fitted together as one
batch of small arrays, so a search costs a few array passes per series. The
criteria of candidates with the same differencing rest on the same sample;
across differencings they are not comparable.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import match, spread
from .packing import key_fields, month_ends, pack_series

Order = tuple[int, int, int]
# The default order and the largest orders searched.
ORDER: Order = (1, 1, 1)
SEASONAL_ORDER: Order = (1, 1, 1)
MAX_ORDER: Order = (3, 2, 3)
MAX_SEASONAL: Order = (2, 1, 2)
PERIOD = 12


def difference(y: np.ndarray, d: int, seasonal_d: int, period: int) -> np.ndarray:
    for _ in range(seasonal_d):
        y = y[period:] - y[:-period] if len(y) > period else y[:0]
    for _ in range(d):
        y = np.diff(y)
    return y


def lag_weights(params: np.ndarray, short: slice, long: slice, period: int, sign: float) -> np.ndarray:
    """Lag coefficients 1..L of (1 + sign*short)(1 + sign*long at the period) - 1, one row per candidate."""
    a, b = sign * params[:, short], sign * params[:, long]
    out = np.zeros((len(params), a.shape[1] + b.shape[1] * period + 1))
    left = np.concatenate([np.ones((len(params), 1)), a], axis=1)
    out[:, : left.shape[1]] += left
    for j in range(b.shape[1]):
        start = (j + 1) * period
        out[:, start : start + left.shape[1]] += left * b[:, j : j + 1]
    return out[:, 1:]


class Layout:
    """Where each kind of coefficient sits in a parameter row, for the largest orders of a batch."""

    def __init__(self, p: int, q: int, sp: int, sq: int, period: int):
        ends = np.cumsum([0, p, q, sp, sq])
        self.p, self.q, self.sp, self.sq = (slice(int(a), int(b)) for a, b in zip(ends[:-1], ends[1:]))
        self.size, self.period = int(ends[-1]), period

    def mask(self, p: int, q: int, sp: int, sq: int) -> np.ndarray:
        m = np.zeros(self.size, dtype=bool)
        for part, n in ((self.p, p), (self.q, q), (self.sp, sp), (self.sq, sq)):
            m[part.start : part.start + n] = True
        return m

    def weights(self, params: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ar = -lag_weights(params, self.p, self.sp, self.period, -1.0)
        return ar, lag_weights(params, self.q, self.sq, self.period, 1.0)


def css_residuals(z: np.ndarray, params: np.ndarray, layout: Layout) -> np.ndarray:
    """One-step errors, one row per candidate, running the moving-average part forward in time."""
    ar, ma = layout.weights(params)
    n, n_ar, n_ma = len(z), ar.shape[1], ma.shape[1]
    lagged = np.zeros((n, n_ar))
    for i in range(1, min(n_ar, n - 1) + 1):
        lagged[i:, i - 1] = z[:-i]
    base = z[None, :] - ar @ lagged.T
    if not ma.any():
        return base
    errors = np.zeros((len(params), n + n_ma))
    backward = ma[:, ::-1]
    with np.errstate(all="ignore"):
        for t in range(n):
            errors[:, n_ma + t] = base[:, t] - np.einsum("bl,bl->b", backward, errors[:, t : t + n_ma])
    return errors[:, n_ma:]


def css_fit(z: np.ndarray, masks: np.ndarray, layout: Layout, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """(params, sse) of every candidate by damped Gauss-Newton steps taken for the whole batch at once."""
    n_cand, k = masks.shape
    params = np.where(masks, 0.1, 0.0)
    bound = np.ones(k) * 0.98
    damping = np.full(n_cand, 1e-2)
    eye, step = np.eye(k), 1e-5

    def sse_of(r: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            s = np.einsum("bt,bt->b", r, r)
        return np.where(np.isfinite(s), s, np.inf)

    resid = css_residuals(z, params, layout)
    sse = sse_of(resid)
    last = False
    for turn in range(rounds + 1 if k else 0):  # without weights there is nothing to fit
        if last or turn == rounds:  # a whole step at the end: where the errors are linear in the weights it lands on the solution
            last, damping = True, np.full(n_cand, 1e-12)
        moved = (params[:, None, :] + step * eye[None]).reshape(-1, k)
        slopes = (css_residuals(z, moved, layout).reshape(n_cand, k, -1) - resid[:, None, :]) / step
        slopes = np.nan_to_num(slopes * masks[:, :, None], posinf=0.0, neginf=0.0)
        gram = np.einsum("bkt,blt->bkl", slopes, slopes)
        pull = np.einsum("bkt,bt->bk", slopes, np.nan_to_num(resid, posinf=0.0, neginf=0.0))
        diag = np.einsum("bkk->bk", gram)
        ridge = damping[:, None] * (diag + 1e-8 * (diag.max(axis=1, keepdims=True) + 1e-12)) + ~masks
        # alike columns leave nothing to solve but for a little on the diagonal
        floor = 1e-13 * (diag.max(axis=1, keepdims=True) + 1e-12)
        delta = np.linalg.solve(gram + (ridge + floor)[:, :, None] * eye[None], pull[:, :, None])[:, :, 0]
        trial = np.clip(params - delta * masks, -bound, bound)
        trial_resid = css_residuals(z, trial, layout)
        trial_sse = sse_of(trial_resid)
        better = trial_sse < (sse * (1 + 1e-12) if last else sse)
        gain = np.where(better, sse - trial_sse, 0.0)
        params = np.where(better[:, None], trial, params)
        resid = np.where(better[:, None], trial_resid, resid)
        damping = np.clip(np.where(better, damping * 0.3, damping * 10.0), 1e-8, 1e8)
        done = np.all((gain <= 1e-9 * sse) & (better | (damping > 1e6)))
        sse = np.where(better, trial_sse, sse)
        if last:
            break
        last = bool(done)
    return params, sse


def criteria(sse: np.ndarray, n: int, k: np.ndarray) -> dict[str, np.ndarray]:
    with np.errstate(all="ignore"):
        fit = n * np.log(sse / n) + n * (1 + np.log(2 * np.pi))
    free = k + 1
    return {"aic": fit + 2 * free, "bic": fit + np.log(n) * free, "hqic": fit + 2 * np.log(np.log(n)) * free}


def project(recent: np.ndarray, c: np.ndarray, ma: np.ndarray, shocks: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """(point forecasts, psi weights) from the last values, the lag coefficients ``c`` of the raw series and the last errors."""
    past, noise = list(recent), list(shocks)
    for h in range(horizon):
        level = sum(c[i] * past[-1 - i] for i in range(min(len(c), len(past))))
        shock = sum(ma[j] * noise[-1 - j] for j in range(min(len(ma), len(noise))))
        past.append(level + shock)
        noise.append(0.0)
    psi = np.zeros(horizon)
    for h in range(horizon):
        psi[h] = 1.0 if h == 0 else (ma[h - 1] if h <= len(ma) else 0.0)
        psi[h] += sum(c[i] * psi[h - 1 - i] for i in range(min(len(c), h)))
    return np.array(past[-horizon:]), psi


# ---- Spark jobs ---------------------------------------------------------------------------


def order_grid(max_order: Order, max_seasonal: Order) -> list[Order]:
    """(p, q, P, Q) combinations of one differencing."""
    return list(
        product(range(max_order[0] + 1), range(max_order[2] + 1), range(max_seasonal[0] + 1), range(max_seasonal[2] + 1))
    )


def order_search(
    df: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "ts",
    y: str = "y",
    max_order: Order = MAX_ORDER,
    max_seasonal: Order = MAX_SEASONAL,
    period: int = PERIOD,
) -> DataFrame:
    """(keys, p, d, q, P, D, Q as sp, sd, sq, aic, bic, hqic, diff_std, n_eff, status): every candidate of every series.

    Work is spread by (series, differencing); a candidate that cannot be fitted
    is a row with status ``failed``.
    """
    packed = pack_series(df, keys, ts, (y,))
    pairs = F.array(
        *[F.struct(F.lit(d).alias("d"), F.lit(sd).alias("sd")) for d in range(max_order[1] + 1) for sd in range(max_seasonal[1] + 1)]
    )
    jobs = packed.select(*keys, F.col(y).alias("_y"), F.explode(pairs).alias("_p")).select(*keys, "_y", "_p.*")
    grid = order_grid(max_order, (max_seasonal[0] if period > 1 else 0, 0, max_seasonal[2] if period > 1 else 0))
    layout = Layout(max_order[0], max_order[2], max_seasonal[0], max_seasonal[2], period)
    masks = np.array([layout.mask(p, q, sp, sq) for p, q, sp, sq in grid])
    names = list(keys)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False, name=None):
                at = dict(zip(pdf.columns, row))
                z = difference(np.asarray(at["_y"], dtype=float), at["d"], at["sd"], period)
                out = pd.DataFrame(grid, columns=["p", "q", "sp", "sq"])
                ok = len(z) > layout.size + 2 and bool(np.std(z) > 0)
                if ok:
                    scale = float(np.std(z))
                    _, sse = css_fit(z / scale, masks, layout)
                    found = criteria(sse * scale**2, len(z), masks.sum(axis=1))
                else:
                    found = {c: np.full(len(grid), np.nan) for c in ("aic", "bic", "hqic")}
                for c, v in found.items():
                    out[c] = np.where(np.isfinite(v), v, np.nan)
                out["status"] = np.where(np.isfinite(found["aic"]), "success", "failed")
                yield out.assign(d=at["d"], sd=at["sd"], n_eff=len(z), diff_std=float(np.std(z)) if len(z) else np.nan,
                                 **{k: at[k] for k in names})

    fields = key_fields(df, keys) + [T.StructField(c, T.IntegerType()) for c in ("p", "d", "q", "sp", "sd", "sq", "n_eff")]
    fields += [T.StructField(c, T.DoubleType()) for c in ("diff_std", "aic", "bic", "hqic")] + [T.StructField("status", T.StringType())]
    found = spread(jobs, *keys, "d", "sd").mapInPandas(fit, T.StructType(fields))
    numbers = {c: F.when(~F.isnan(c), F.col(c)) for c in ("diff_std", "aic", "bic", "hqic")}
    return found.withColumns(numbers)


def best_orders(search: DataFrame, keys: Sequence[str] = (), rule: str = "differencing") -> DataFrame:
    """One order per series: lowest AIC within the differencing of least variance, or (rule ``aic``) overall."""
    if rule not in ("differencing", "aic"):
        raise ValueError(f"unknown rule {rule!r}; differencing or aic")
    good = search.where((F.col("status") == "success") & F.col("aic").isNotNull())
    simple = [F.col("p") + F.col("q") + F.col("sp") + F.col("sq"), "p", "q", "sp", "sq"]
    first = [F.col("diff_std"), F.col("d") + F.col("sd")] if rule == "differencing" else []
    order = Window.partitionBy(*keys).orderBy(*first, "aic", *simple, "d", "sd")
    return good.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


MODEL_FIELDS = [
    *[T.StructField(c, T.IntegerType()) for c in ("p", "d", "q", "sp", "sd", "sq", "n", "n_eff")],
    *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("params", "beta", "ar", "ma", "recent", "shocks")],
    *[T.StructField(c, T.DoubleType()) for c in ("last_value", "sigma", "aic", "bic")],
    T.StructField("status", T.StringType()),
]
_ORDER = ("p", "d", "q", "sp", "sd", "sq")


def _folded(ar: np.ndarray, d: int, seasonal_d: int, period: int) -> np.ndarray:
    """Lag coefficients of the raw series: the differencing is folded into the autoregression."""
    full = np.concatenate([[1.0], -ar])
    for _ in range(d):
        full = np.convolve(full, [1.0, -1.0])
    for _ in range(seasonal_d):
        full = np.convolve(full, np.concatenate([[1.0], np.zeros(period - 1), [-1.0]]))
    return -full[1:]


@dataclass
class SeriesFit:
    """One series' fit: its model row, and its one-step errors (as many as differenced values)."""

    row: dict
    errors: np.ndarray


def fit_series(values: np.ndarray, x: np.ndarray | None, order: Sequence[int], period: int) -> SeriesFit:
    """Fit one series; ``x`` are regressors whose effect is taken off first."""
    p, d, q, sp, sd, sq = (int(v) for v in order)
    layout = Layout(p, q, sp, sq, period)
    last, beta = float(values[-1]), np.zeros(0)
    if x is not None:
        dx = np.column_stack([difference(x[:, i], d, sd, period) for i in range(x.shape[1])])
        dy = difference(values, d, sd, period)
        if len(dy) > x.shape[1]:
            beta = np.linalg.lstsq(dx, dy, rcond=None)[0]
            values = values - x @ beta
            last = float(values[-1])
    z = difference(values, d, sd, period)
    row = {**dict(zip(_ORDER, (p, d, q, sp, sd, sq))), "n": len(values), "n_eff": len(z), "beta": beta, "last_value": last}
    if len(z) <= layout.size + 2 or not np.all(np.isfinite(values)):
        none = np.zeros(0)
        return SeriesFit({**row, "params": none, "ar": none, "ma": none, "recent": none, "shocks": none, "sigma": None, "aic": None, "bic": None, "status": "short"}, none)
    scale = float(np.std(z)) or 1.0
    params, sse = css_fit(z / scale, layout.mask(p, q, sp, sq)[None, :], layout)
    errors = css_residuals(z, params, layout)[0]  # of the values as they are: scaled down and up again they come back an ulp off
    ar, ma = layout.weights(params)
    folded = _folded(ar[0], d, sd, period)
    found = criteria(sse * scale**2, len(z), np.array([layout.size]))
    number = lambda v: float(v) if np.isfinite(v) else None
    row |= {
        "params": params[0], "ar": folded, "ma": ma[0], "recent": values[max(0, len(values) - len(folded)) :], "shocks": errors[max(0, len(errors) - ma.shape[1]) :] if ma.shape[1] else np.zeros(0),
        "sigma": float(scale * np.sqrt(sse[0] / max(len(z) - layout.size, 1))), "aic": number(found["aic"][0]), "bic": number(found["bic"][0]), "status": "success",
    }
    return SeriesFit(row, errors)


def _jobs(
    df: DataFrame, keys: Sequence[str], ts: str, y: str, order: Order, seasonal: Order, orders: DataFrame | None, exog: Sequence[str], times: bool = False
) -> DataFrame:
    packed = pack_series(df.withColumn("_at", F.unix_date(F.to_date(ts))) if times else df, keys, ts, (y, *exog, *(["_at"] if times else [])))
    if orders is None:
        return packed.select("*", *[F.lit(v).alias(c) for c, v in zip(_ORDER, (*order, *seasonal))])
    picked = orders.select(*keys, *_ORDER)
    jobs = match(packed, picked, keys, "left") if keys else packed.select("*", *[picked.select(c).scalar().alias(c) for c in _ORDER])
    return jobs.na.fill(dict(zip(_ORDER, (*order, *seasonal))))


def _series(at: dict, y: str, exog: Sequence[str], period: int) -> SeriesFit:
    x = np.column_stack([np.asarray(at[c], dtype=float) for c in exog]) if exog else None
    return fit_series(np.asarray(at[y], dtype=float), x, [at[c] for c in _ORDER], period)


def arima_train(
    df: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "ts",
    y: str = "y",
    order: Order = ORDER,
    seasonal: Order = SEASONAL_ORDER,
    period: int = PERIOD,
    orders: DataFrame | None = None,
    exog: Sequence[str] = (),
) -> DataFrame:
    """The model table: one row per series with its order, coefficients, criteria and last state.

    The state is what a forecast needs and no more: as many last values
    (``recent``) and errors (``shocks``) as there are lag coefficients.
    """
    names, exog = list(keys), list(exog)
    jobs = _jobs(df, keys, ts, y, order, seasonal, orders, exog)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                at = dict(zip(pdf.columns, row))
                out.append({**{k: at[k] for k in names}, "last_ts": at["last_ts"], **_series(at, y, exog, period).row})
            if out:
                yield pd.DataFrame(out)

    schema = T.StructType(key_fields(df, keys) + [jobs.schema["last_ts"], *MODEL_FIELDS])
    return spread(jobs, *keys).mapInPandas(run, schema)


def arima_residuals(
    df: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "ts",
    y: str = "y",
    order: Order = ORDER,
    seasonal: Order = SEASONAL_ORDER,
    period: int = PERIOD,
    orders: DataFrame | None = None,
    exog: Sequence[str] = (),
) -> DataFrame:
    """(keys, ts, y, yhat, resid): one-step forecasts of the training rows, from the first row that has a differenced value on.

    ``yhat`` is y less the error of the filter; feed it to the metrics, and
    ``resid`` to the residual analysis and the Ljung-Box test. A series too
    short to fit gives no row.
    """
    names, exog = list(keys), list(exog)
    jobs = _jobs(df, keys, ts, y, order, seasonal, orders, exog, times=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False, name=None):
                at = dict(zip(pdf.columns, row))
                errors = _series(at, y, exog, period).errors
                if not len(errors):
                    continue
                days, values = np.asarray(at["_at"])[-len(errors) :], np.asarray(at[y], dtype=float)[-len(errors) :]
                dates = np.array(days, dtype="datetime64[D]").astype(object)
                yield pd.DataFrame({**{k: [at[k]] * len(errors) for k in names}, "ts": dates, "y": values, "yhat": values - errors, "resid": errors})

    fields = key_fields(df, keys) + [T.StructField("ts", T.DateType())] + [T.StructField(c, T.DoubleType()) for c in ("y", "yhat", "resid")]
    return spread(jobs, *keys).mapInPandas(run, T.StructType(fields))


def arima_predict(
    models: DataFrame, keys: Sequence[str] = (), horizon: int = 12, future_exog: DataFrame | None = None, exog: Sequence[str] = (), level: float = 0.95
) -> DataFrame:
    """(keys, step, ds, yhat, lower, upper, status) from a model table alone; a model with regressors needs their future values."""
    names, z_level, exog = list(keys), NormalDist().inv_cdf(0.5 + level / 2), list(exog)
    jobs = models
    if exog:
        if future_exog is None:
            raise ValueError("future_exog is needed with exog")
        ahead = pack_series(future_exog.where(F.col("step") <= horizon), keys, "step", exog).drop("last_ts")
        ahead = ahead.withColumnsRenamed({c: f"_next_{c}" for c in exog})
        jobs = match(jobs, ahead, keys, "left") if keys else jobs.select(
            "*", *[ahead.select(f"_next_{c}").scalar().alias(f"_next_{c}") for c in exog]
        )

    def predict(at: dict) -> tuple[np.ndarray, np.ndarray, str]:
        drift, beta = np.zeros(horizon), np.asarray(at["beta"], dtype=float)
        if exog and len(beta):
            ahead = [at[f"_next_{c}"] for c in exog]
            if any(a is None or len(a) < horizon for a in ahead):
                return np.full(horizon, np.nan), np.full(horizon, np.nan), "no future regressors"
            drift = np.column_stack([np.asarray(a, dtype=float) for a in ahead])[:horizon] @ beta
        if at["status"] != "success":
            return np.full(horizon, at["last_value"]) + drift, np.full(horizon, np.nan), at["status"]
        point, psi = project(*(np.asarray(at[c], dtype=float) for c in ("recent", "ar", "ma", "shocks")), horizon)
        return point + drift, z_level * at["sigma"] * np.sqrt(np.cumsum(psi**2)), "success"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False, name=None):
                at = dict(zip(pdf.columns, row))
                point, half, status = predict(at)
                yield pd.DataFrame(
                    {**{k: [at[k]] * horizon for k in names}, "last_ts": at["last_ts"], "step": range(1, horizon + 1),
                     "yhat": point, "lower": point - half, "upper": point + half, "status": status}
                )

    fields = key_fields(models, keys) + [models.schema["last_ts"], T.StructField("step", T.IntegerType())]
    fields += [T.StructField(c, T.DoubleType()) for c in ("yhat", "lower", "upper")] + [T.StructField("status", T.StringType())]
    made = jobs.mapInPandas(run, T.StructType(fields))
    bounds = {c: F.when(~F.isnan(c), F.col(c)) for c in ("yhat", "lower", "upper")}
    return month_ends(made).withColumns(bounds).select(*keys, "step", "ds", "yhat", "lower", "upper", "status")


def arima_forecast(
    df: DataFrame,
    keys: Sequence[str] = (),
    horizon: int = 12,
    ts: str = "ts",
    y: str = "y",
    order: Order = ORDER,
    seasonal: Order = SEASONAL_ORDER,
    period: int = PERIOD,
    orders: DataFrame | None = None,
    exog: Sequence[str] = (),
    future_exog: DataFrame | None = None,
    level: float = 0.95,
) -> DataFrame:
    """(keys, step, ds, yhat, lower, upper, status) by series: :func:`arima_train`, then :func:`arima_predict`.

    ``orders`` (from :func:`best_orders`) gives each series its own order.
    ``exog`` columns act through a regression on the differenced series, the
    ARIMA modelling its errors; their future values come in ``future_exog``
    (keys, step, columns), and a series without them gets no forecast. Too short
    a series repeats its last value with status ``short``.
    """
    if exog and future_exog is None:
        raise ValueError("future_exog is needed with exog")
    models = arima_train(df, keys, ts, y, order, seasonal, period, orders, exog)
    return arima_predict(models, keys, horizon, future_exog, exog, level)
