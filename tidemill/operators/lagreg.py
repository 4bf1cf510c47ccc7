"""Lag regression: linear, ridge or lasso on lagged features, per series or pooled over a panel."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import attach, by_time, match, per_series, ratio, spread
from ..session import settle
from . import gram
from .features import WINDOWS, apply_scaler, fit_scaler, model_feature_columns
from .packing import key_fields, month_ends

N_LAGS = 12
Z95 = 1.96


def lagged_frame(
    df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y", before: DataFrame | None = None
) -> tuple[DataFrame, list[str]]:
    """The panel with its lagged features as one array ``x``, and the feature names in order.

    Every frame ends one row before the target. A feature that is undefined
    (a growth from zero) counts as 0; rows without a full window are dropped.
    ``before`` (keys, n, recent, as in a model table) says what came before the
    rows: they continue its series, and those not after its last time are left out.
    """
    rows, first = df.select(*keys, ts, y), None
    if before is not None:
        old = before.select(*keys, "n", F.explode("recent").alias("_r"))
        old = old.select(*keys, F.col("_r.ts").alias(ts), F.col("_r.y").alias(y), (F.col("n") - N_LAGS).alias("_base"))
        rows = old.unionByName(rows.withColumn("_base", F.lit(None).cast("bigint")))
        last = F.max(F.when(F.col("_base").isNotNull(), F.col(ts))).over(per_series(keys))
        rows = rows.withColumn("_last", last).where(F.col("_base").isNotNull() | F.col("_last").isNull() | (F.col(ts) > F.col("_last")))
        # a series shorter than the window is held whole, so its rows begin at 0
        first = F.greatest(F.coalesce(F.max("_base").over(per_series(keys)), F.lit(0)), F.lit(0))
    # calendar features are read at month ends, as the forecasts are labelled
    made = model_feature_columns(keys, "_end", y, N_LAGS, WINDOWS, lagged=True, before=first)
    names = list(made)
    rows = rows.withColumn("_end", F.last_day(ts)).withColumns(made).where(F.col(f"rolling_mean_{max(WINDOWS)}").isNotNull())
    if before is not None:
        rows = rows.where(F.col("_base").isNull())
    values = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names]
    return rows.select(*keys, ts, F.col(y).cast("double").alias("y"), F.array(*values).alias("x")), names


@dataclass(frozen=True)
class LagRegression:
    """kind: linear, ridge or lasso; the n_features features of largest |r| are kept (None keeps all);
    degree > 1 adds products of different features."""

    kind: str = "linear"
    alpha: float = 1.0
    n_features: int | None = 15
    degree: int = 1

    def expand(self, x: np.ndarray, names: Sequence[str]) -> tuple[np.ndarray, list[str]]:
        columns, labels = [x], list(names)
        for size in range(2, self.degree + 1):
            for group in combinations(range(len(names)), size):
                columns.append(np.prod(x[:, group], axis=1, keepdims=True))
                labels.append(" ".join(names[i] for i in group))
        return np.hstack(columns), labels

    def select(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            dx, dy = x - x.mean(axis=0), y - y.mean()
            r = np.abs(dx.T @ dy) / np.sqrt((dx**2).sum(axis=0) * (dy**2).sum())
        r = np.round(np.where(np.isfinite(r), r, -1.0), 10)  # features that carry the same go in their order
        keep = len(r) if self.n_features is None else min(self.n_features, len(r))
        return np.sort(np.argsort(-r, kind="stable")[:keep])

    def coefficients(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For standardised x and centred y."""
        if self.kind == "linear":
            return np.linalg.lstsq(x, y, rcond=None)[0]
        if self.kind == "ridge":
            return np.linalg.solve(x.T @ x + self.alpha * np.eye(x.shape[1]), x.T @ y)
        if self.kind == "lasso":
            return gram.lasso(x.T @ x / len(x), x.T @ y / len(x), self.alpha)
        raise ValueError(f"unknown kind {self.kind!r}; linear, ridge or lasso")

    def from_sums(self, sums: gram.Moments, names: Sequence[str]) -> dict:
        """The model of one series from its Gram matrix (degree 1)."""
        r = np.round(sums.correlations(), 10)
        keep = len(r) if self.n_features is None else min(self.n_features, len(r))
        kept = np.sort(np.argsort(-r, kind="stable")[:keep])
        products, target = sums.pick(kept)
        if self.kind == "linear":
            coef = gram.least_squares(products, target)
        elif self.kind == "ridge":
            coef = gram.ridge(products, target, self.alpha, sums.n)
        elif self.kind == "lasso":
            coef = gram.lasso(products, target, self.alpha)
        else:
            raise ValueError(f"unknown kind {self.kind!r}; linear, ridge or lasso")
        left = max(sums.total - 2 * coef @ target + coef @ products @ coef, 0.0)
        return {
            "features": [names[i] for i in kept], "center": sums.center[kept], "width": sums.width[kept], "coef": coef, "intercept": sums.mean,
            "resid_std": float(np.sqrt(left)), "r2": float(1 - left / sums.total) if sums.total > 0 else None, "mae": None, "rmse": float(np.sqrt(left)),
            "n_rows": int(sums.n), "n_nonzero": int((np.abs(coef) > 1e-6).sum()),
        }


MODEL_FIELDS = [
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("center", T.ArrayType(T.DoubleType())),
    T.StructField("width", T.ArrayType(T.DoubleType())),
    T.StructField("coef", T.ArrayType(T.DoubleType())),
    *[T.StructField(c, T.DoubleType()) for c in ("intercept", "resid_std", "r2", "mae", "rmse")],
    T.StructField("n_rows", T.IntegerType()),
    T.StructField("n_nonzero", T.IntegerType()),
]


def solve_sums(sums: DataFrame, keys: Sequence[str], names: Sequence[str], model: LagRegression) -> DataFrame:
    """(keys, the fields of a model) from (keys, gram): one small solve for each series, no row of which is looked at. ``mae`` stays null."""
    key_names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = pd.DataFrame([model.from_sums(gram.Moments(g), names) for g in pdf["gram"]], columns=[f.name for f in MODEL_FIELDS])
            yield pd.concat([pdf[key_names].reset_index(drop=True), made], axis=1)

    return spread(sums, *keys).mapInPandas(run, T.StructType(key_fields(sums, keys) + MODEL_FIELDS))


def predicted(x: str, names: Sequence[str]) -> Column:
    """The value a model (features, center, width, coef, intercept) gives for the features ``x``, an array in the order of ``names``."""
    order = F.array(*[F.lit(n) for n in names])
    parts = F.arrays_zip("features", "center", "width", "coef")
    term = lambda s: s["coef"] * (F.element_at(F.col(x), F.array_position(order, s["features"]).cast("int")) - s["center"]) / s["width"]
    return F.aggregate(parts, F.col("intercept"), lambda total, s: total + term(s))


def _rows_of(df: DataFrame, keys: Sequence[str], ts: str, y: str, features: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    rows, names = lagged_frame(df, keys, ts, y)
    if not features:
        return rows, names
    wanted = [names.index(f) for f in features]
    return rows.withColumn("x", F.array(*[F.col("x")[i] for i in wanted])), list(features)


def lag_regression_fit(
    df: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "ts",
    y: str = "y",
    model: LagRegression = LagRegression(),
    features: Sequence[str] | None = None,
    errors: bool = True,
) -> DataFrame:
    """One row per series: chosen features, their scaling and coefficients, R2, MAE, RMSE, non-zero count.

    ``features`` restricts the candidates. Starts a job that makes the features once. Of degree 1 the model is solved from
    sums of products made in the JVM (:mod:`.gram`); ``mae`` then takes a second
    look at the rows, which ``errors=False`` leaves out. Products of features
    (degree above 1) are made series by series.
    """
    rows, names = _rows_of(df, keys, ts, y, features)
    if model.degree > 1:
        return _fit_products(rows, keys, ts, names, model)
    rows = settle(rows)  # made once, for the sums and for the errors
    models = solve_sums(gram.gram_sums(rows, keys, "x", "y", len(names)), keys, names, model)
    if not errors:
        return models
    if keys:
        beside = match(rows, models.select(*keys, "features", "center", "width", "coef", "intercept"), keys)
    else:
        facts = models.select(F.struct("features", "center", "width", "coef", "intercept")).scalar().alias("_m")
        beside = rows.select("*", facts).select("y", "x", "_m.*")
    off = beside.groupBy(*keys).agg(F.avg(F.abs(F.col("y") - predicted("x", names))).alias("mae"))
    return attach(models.drop("mae"), off, keys, "_e").select(*keys, *[F.col("_e.mae").alias("mae") if f.name == "mae" else f.name for f in MODEL_FIELDS])


def _fit_products(rows: DataFrame, keys: Sequence[str], ts: str, names: Sequence[str], model: LagRegression) -> DataFrame:
    key_names = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        x, target = np.vstack(pdf["x"].to_numpy()).astype(float), pdf["y"].to_numpy(dtype=float)
        kept = model.select(x, target)
        x, labels = model.expand(x[:, kept], [names[i] for i in kept])
        center, width = x.mean(axis=0), x.std(axis=0)
        width = np.where(width > 0, width, 1.0)
        z = (x - center) / width
        coef = model.coefficients(z, target - target.mean())
        resid = target - target.mean() - z @ coef
        total = ((target - target.mean()) ** 2).sum()
        record = {
            "features": labels, "center": center, "width": width, "coef": coef, "intercept": float(target.mean()),
            "resid_std": float(resid.std()), "r2": float(1 - (resid**2).sum() / total) if total > 0 else None,
            "mae": float(np.abs(resid).mean()), "rmse": float(np.sqrt((resid**2).mean())),
            "n_rows": len(target), "n_nonzero": int((np.abs(coef) > 1e-6).sum()),
        }
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in key_names}, **record}])

    schema = T.StructType(key_fields(rows, keys) + MODEL_FIELDS)
    return spread(rows, *keys).groupBy(*keys).applyInPandas(run, schema)


# ---- model tables: fitted once, used and fitted on later ------------------------------------


def series_state(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y", size: int = N_LAGS) -> DataFrame:
    """(keys, n, last_ts, recent): rows so far and the last ``size`` of them (ts, y), oldest first."""
    late = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ts))) <= size
    item = F.struct(F.col(ts).alias("ts"), F.col(y).cast("double").alias("y"))
    held = F.sort_array(F.collect_list(F.when(F.col("_late"), item)))  # nulls are not collected
    return df.withColumn("_late", late).groupBy(*keys).agg(F.count("*").alias("n"), F.max(ts).alias("last_ts"), held.alias("recent"))


def lag_regression_train(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y", model: LagRegression = LagRegression()) -> DataFrame:
    """The model table of every series: its regression, its sums of products (gram), and its state (n, last_ts, recent)."""
    if model.degree > 1:
        raise ValueError("sums of products are kept for models of degree 1")
    rows, names = lagged_frame(df, keys, ts, y)
    return _with_models(series_state(df, keys, ts, y), gram.gram_sums(settle(rows), keys, "x", "y", len(names)), keys, names, model)


def _with_models(state: DataFrame, sums: DataFrame, keys: Sequence[str], names: Sequence[str], model: LagRegression) -> DataFrame:
    sums = settle(sums)
    held = attach(state, sums, keys, "_g")
    made = attach(held, solve_sums(sums, keys, names, model), keys, "_m")
    return made.select(*keys, "n", "last_ts", "recent", F.col("_g.gram").alias("gram"), *[F.col(f"_m.{f.name}").alias(f.name) for f in MODEL_FIELDS])


def lag_regression_retrain(models: DataFrame, new: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y", model: LagRegression = LagRegression()) -> DataFrame:
    """The model table of old and new rows together, from the old table and the ``new`` rows alone.

    New rows not after a series' last time are left out; series may be new, and
    those without new rows stay as they are.
    """
    rows, names = lagged_frame(new, keys, ts, y, before=models)
    more = gram.gram_sums(settle(rows), keys, "x", "y", len(names))
    state = merged_state(models, new, keys, ts, y)
    old = attach(state.select(*keys), models.select(*keys, "gram"), keys, "_o")
    both = attach(old, more, keys, "_n").select(*keys, gram.added(F.col("_o.gram"), F.col("_n.gram")).alias("gram"))
    return _with_models(state, both.where(F.col("gram").isNotNull()), keys, names, model)


def merged_state(models: DataFrame, new: DataFrame, keys: Sequence[str], ts: str = "ts", y: str = "y", size: int = N_LAGS) -> DataFrame:
    """The state of old and new rows together, from the old state and the new rows."""
    item = F.struct(F.col(ts).alias("ts"), F.col(y).cast("double").alias("y"))
    held = models.select(*keys, "n", "recent", "last_ts").withColumn("_more", F.lit(0).cast("bigint"))
    beside = attach(new, held.select(*keys, "last_ts"), keys, "_old")
    fresh = beside.where(F.col("_old.last_ts").isNull() | (F.col(ts) > F.col("_old.last_ts"))).drop("_old")
    late = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ts))) <= size
    added = fresh.withColumn("_late", late).groupBy(*keys).agg(
        F.lit(0).cast("bigint").alias("n"), F.sort_array(F.collect_list(F.when(F.col("_late"), item))).alias("recent"), F.max(ts).alias("last_ts"), F.count("*").alias("_more")
    )
    both = held.unionByName(added).groupBy(*keys).agg(
        (F.sum("n") + F.sum("_more")).alias("n"), F.max("last_ts").alias("last_ts"), F.sort_array(F.flatten(F.collect_list("recent"))).alias("_r")
    )
    return both.select(*keys, "n", "last_ts", F.slice("_r", F.greatest(F.size("_r") - size, F.lit(0)) + 1, size).alias("recent"))


def coefficient_importance(models: DataFrame, keys: Sequence[str] = (), k: int | None = None) -> DataFrame:
    """(keys, feature, coef, importance, rank): coefficients by size, ties by name; the k largest if given."""
    pairs = models.select(*keys, F.explode(F.arrays_zip("features", "coef")).alias("_p"))
    rows = pairs.select(*keys, F.col("_p.features").alias("feature"), F.col("_p.coef").alias("coef"))
    rows = rows.withColumn("importance", F.abs("coef"))
    order = Window.partitionBy(*keys).orderBy(F.desc("importance"), "feature")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def next_features(recent: np.ndarray, index: np.ndarray, month_no: np.ndarray) -> dict[str, np.ndarray]:
    """Lagged features of the next row for a batch of series.

    ``recent`` holds each series' last values (newest last), ``index`` the next
    row's number, ``month_no`` its months since year 0.
    """
    month = month_no % 12 + 1
    quarter = (month - 1) // 3 + 1
    year = month_no // 12
    last_day = (np.datetime64("0000-01", "M") + month_no + 1).astype("datetime64[D]") - 1
    first_day = (np.datetime64("0000-01", "M") + year * 12).astype("datetime64[D]")

    def safe(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros_like(a), where=b != 0)

    out = {f"y_lag_{k}": recent[:, -k] for k in range(1, N_LAGS + 1)}
    for n in WINDOWS:
        tail = recent[:, -n:]
        out |= {
            f"rolling_mean_{n}": tail.mean(axis=1),
            f"rolling_std_{n}": tail.std(axis=1, ddof=1),
            f"rolling_min_{n}": tail.min(axis=1),
            f"rolling_max_{n}": tail.max(axis=1),
        }
    short, long = out["rolling_mean_3"], out["rolling_mean_12"]
    growth = safe(recent[:, -1] - recent[:, -2], recent[:, -2])
    wave = 2 * np.pi
    out |= {
        "year": year, "month": month, "quarter": quarter,
        "day_of_year": (last_day - first_day).astype(int) + 1,
        "month_sin": np.sin(wave * month / 12), "month_cos": np.cos(wave * month / 12),
        "quarter_sin": np.sin(wave * quarter / 4), "quarter_cos": np.cos(wave * quarter / 4),
        "linear_trend": index, "quadratic_trend": index**2,
        "growth_rate": growth, "momentum": recent[:, -1] - recent[:, -2],
        "ma_ratio": safe(short, long), "ma_diff": short - long, "volatility": safe(out["rolling_std_12"], long),
        "is_q4": quarter == 4, "is_holiday_season": (month == 12) | (month == 1),
        "trend_month": index * month, "growth_season": growth * np.sin(wave * month / 12),
    }
    return {name: np.asarray(v, dtype=float) for name, v in out.items()}


def lag_regression_forecast(
    df: DataFrame,
    keys: Sequence[str] = (),
    horizon: int = 12,
    ts: str = "ts",
    y: str = "y",
    model: LagRegression = LagRegression(),
    models: DataFrame | None = None,
) -> DataFrame:
    """(keys, step, ds, yhat, lower, upper): each prediction feeds the next step's features."""
    df = settle(df.select(*keys, ts, y))
    fitted = models if models is not None else lag_regression_fit(df, keys, ts, y, model, errors=False)
    state = series_state(df, keys, ts, y)
    needed = [f.name for f in MODEL_FIELDS[:6]]
    picked = fitted.select(*keys, *needed)
    jobs = match(state, picked, keys) if keys else state.select(
        "*", picked.select(F.struct(*needed)).scalar().alias("_m")
    ).select(*state.columns, "_m.*")
    return lag_regression_predict(jobs, keys, horizon)


def lag_regression_predict(models: DataFrame, keys: Sequence[str] = (), horizon: int = 12) -> DataFrame:
    """(keys, step, ds, yhat, lower, upper) from a model table alone.

    The state of a series is its last 12 values; one that has fewer, or no
    model, gives no row. Series of a batch step forward together. Bounds are
    1.96 population stds of the training residuals.
    """
    state = models.where((F.size("recent") == N_LAGS) & F.col("intercept").isNotNull()).select(
        *keys, "last_ts", "n", F.col("recent.y").alias("recent"), (F.year("last_ts") * 12 + F.month("last_ts") - 1).alias("month_no"),
        *[f.name for f in MODEL_FIELDS[:6]],
    )
    names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            recent = np.vstack(pdf["recent"].to_numpy()).astype(float)
            n, month_no = pdf["n"].to_numpy(dtype=int), pdf["month_no"].to_numpy(dtype=int)
            margin = Z95 * pdf["resid_std"].to_numpy(dtype=float)
            intercept = pdf["intercept"].to_numpy(dtype=float)
            # each label is read once; the factors of every series' terms are places in one table of values
            known = list(next_features(recent[:1], n[:1], month_no[:1]))
            place = {name: i for i, name in enumerate(known)}
            labels = {label: [place[part] for part in label.split(" ")] for row in pdf["features"] for label in row}
            most, deep = max(map(len, pdf["features"])), max((len(x) for x in labels.values()), default=1)
            at = np.full((len(pdf), most, deep), len(known))  # the last value is 1
            center, width, coef = np.zeros((len(pdf), most)), np.ones((len(pdf), most)), np.zeros((len(pdf), most))
            for i, (own, *numbers) in enumerate(zip(pdf["features"], pdf["center"], pdf["width"], pdf["coef"])):
                for j, label in enumerate(own):
                    at[i, j, : len(labels[label])] = labels[label]
                for table, row in zip((center, width, coef), numbers):
                    table[i, : len(row)] = row
            series = np.arange(len(pdf))[:, None, None]
            for h in range(1, horizon + 1):
                values = np.column_stack([*next_features(recent, n + h - 1, month_no + h).values(), np.ones(len(pdf))])
                pred = intercept + ((values[series, at].prod(axis=2) - center) / width * coef).sum(axis=1)
                recent = np.column_stack([recent[:, 1:], pred])
                yield pdf[[*names, "last_ts"]].assign(step=h, yhat=pred, lower=pred - margin, upper=pred + margin)

    fields = key_fields(models, keys) + [state.schema["last_ts"], T.StructField("step", T.IntegerType())]
    fields += [T.StructField(c, T.DoubleType()) for c in ("yhat", "lower", "upper")]
    made = spread(state, *keys).mapInPandas(run, T.StructType(fields))
    return month_ends(made).select(*keys, "step", "ds", "yhat", "lower", "upper")


def pooled_lag_regression(
    df: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    y: str = "y",
    kind: str = "linear",
    alpha: float = 1.0,
    features: Sequence[str] | None = None,
):
    """(Spark ML model, feature names) of one regression over the whole panel, for panels too wide for a model each.

    The target and level features are divided by each series' mean, so large
    series do not outweigh small ones. The penalties follow the usual
    definitions: ridge |e|^2 + alpha |b|^2, lasso |e|^2 / 2n + alpha |b|_1.
    """
    scale = F.avg(y).over(per_series(keys))
    relative = df.select(*keys, ts, ratio(F.col(y).cast("double"), scale).alias("y")).where(F.col("y").isNotNull())
    relative = relative.withColumn("_end", F.last_day(ts))
    made = model_feature_columns(keys, "_end", "y", N_LAGS, WINDOWS, lagged=True)
    chosen = list(features or made)
    # the longest lag marks the rows with a full window
    whole = relative.withColumns({**{c: made[c] for c in chosen}, "_full": F.lag("y", N_LAGS).over(by_time(keys, ts))})
    wide = whole.where(F.col("_full").isNotNull()).select(
        "y", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in chosen]
    )
    wide.persist()  # read by the scaling pass, the penalty pass and the solver
    scaled = apply_scaler(wide, fit_scaler(wide, chosen, "standard"), ())
    ready = VectorAssembler(inputCols=chosen, outputCol="x_vec").transform(scaled).select("y", "x_vec")
    estimator = LinearRegression(featuresCol="x_vec", labelCol="y", standardization=False)
    if kind == "ridge":
        facts = ready.agg(F.count("*").alias("n"), F.stddev_pop("y").alias("s")).first()
        estimator = estimator.setSolver("normal").setElasticNetParam(0.0).setRegParam(alpha / facts["n"] * facts["s"])
    elif kind == "lasso":
        estimator = estimator.setElasticNetParam(1.0).setRegParam(alpha)
    elif kind != "linear":
        raise ValueError(f"unknown kind {kind!r}; linear, ridge or lasso")
    try:
        return estimator.fit(ready), chosen
    finally:
        wide.unpersist()

