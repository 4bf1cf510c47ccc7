"""Forecasting jobs over panels: closed-form members, hold-out scoring, comparison.

Every member is a function ``(panel, keys, horizon) -> (keys, step, ds, yhat,
lower, upper)``; the jobs here run them side by side and put the results into
one long table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import attach, match, per_series
from ..operators import crossval, ensemble, metrics, scenario
from ..operators.trend import indexed
from ..session import settle

Member = Callable[[DataFrame, Sequence[str], int], DataFrame]

# Fixed value: rows a series needs before it is trained on.
MIN_ROWS = 24
PATH_MODELS = ("recent_slope", "seasonal_path", "trend")


def _path_columns(idx: Column, step: Column, last_month: Column) -> list[Column]:
    """The three closed-form paths from a series' facts (slope, intercept, slope12, last_value)."""
    recent = F.col("_last") + step * F.col("_slope12")
    swing = F.col("_last") + step * F.col("_slope12") * scenario.season_factor(step, last_month)
    line = F.col("_intercept") + F.col("_slope") * idx
    return [
        F.struct(F.lit(name).alias("model"), value.alias("yhat"))
        for name, value in zip(PATH_MODELS, (recent, swing, line))
    ]


def holdout_paths(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y", share: float = 0.8) -> DataFrame:
    """(keys, model, step, ts, y, yhat): the closed-form members fitted on each series' first part,
    beside the actual values of the rest.

    Fit and prediction are window expressions over one partitioning, with no join.
    """
    rows = crossval.holdout_split(df, keys, ts, share)
    whole = per_series(keys)
    x = F.col("idx").cast("double")
    train = F.when(F.col("is_train"), F.col(y))
    near = F.when(F.col("is_train") & (F.col("idx") >= F.col("split") - 12), F.col(y))
    fitted = rows.withColumns(
        {
            "_slope": F.regr_slope(train, x).over(whole),
            "_intercept": F.regr_intercept(train, x).over(whole),
            "_slope12": F.regr_slope(near, x).over(whole),
            "_last": F.max_by(y, F.when(F.col("is_train"), F.col("idx"))).over(whole),
            "_last_ts": F.max(F.when(F.col("is_train"), F.col(ts))).over(whole),
        }
    ).where(~F.col("is_train"))
    step = F.col("idx") - F.col("split") + 1
    members = F.array(*_path_columns(x, step, F.month("_last_ts")))
    return fitted.select(*keys, ts, F.col(y).alias("y"), step.alias("step"), F.explode(members).alias("_m")).select(
        *keys, "_m.model", "step", ts, "y", "_m.yhat"
    )


def future_paths(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y", horizon: int = 12) -> DataFrame:
    """(keys, model, step, ds, yhat): the closed-form members beyond each series' end."""
    rows = indexed(df, keys, ts)
    x = F.col("idx").cast("double")
    near = F.when(F.col("idx") >= F.col("n") - 12, F.col(y))
    facts = rows.groupBy(*keys).agg(
        F.max(ts).alias("_last_ts"),
        F.max("n").alias("_n"),
        F.max_by(y, ts).alias("_last"),
        F.regr_slope(F.col(y), x).alias("_slope"),
        F.regr_intercept(F.col(y), x).alias("_intercept"),
        F.regr_slope(near, x).alias("_slope12"),
    )
    steps = facts.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    step = F.col("step")
    ds = F.last_day(F.add_months(F.trunc("_last_ts", "month"), step))
    members = F.array(*_path_columns(F.col("_n") - 1 + step, step, F.month("_last_ts")))
    return steps.select(*keys, "step", ds.alias("ds"), F.explode(members).alias("_m")).select(
        *keys, "_m.model", "step", "ds", "_m.yhat"
    )


# ---- jobs over any members -----------------------------------------------------------------


def split_parts(df: DataFrame, keys: Sequence[str], ts: str = "ts", share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(training panel, test rows with their step), the same cut for every member."""
    rows = crossval.holdout_split(df, keys, ts, share)
    extras = ("idx", "n", "split", "is_train")
    train = rows.where("is_train").drop(*extras)
    test = rows.where(~F.col("is_train")).withColumn("step", F.col("idx") - F.col("split") + 1).drop(*extras)
    return train, test


def forecast_members(
    df: DataFrame, members: Mapping[str, Member], keys: Sequence[str], horizon: int
) -> DataFrame:
    """All members' forecasts in one long table (keys, model, step, ds, yhat, lower, upper, status)."""
    out: DataFrame | None = None
    for name, member in members.items():
        made = member(df, keys, horizon)
        status = F.col("status") if "status" in made.columns else F.lit("success")
        rows = made.select(
            *keys, F.lit(name).alias("model"), F.col("step").cast("int").alias("step"), "ds", "yhat", "lower", "upper", status.alias("status")
        )
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no members given")
    return out


def holdout_scores(
    df: DataFrame,
    members: Mapping[str, Member],
    keys: Sequence[str],
    horizon: int | None = None,
    share: float = 0.8,
    min_test: int = 3,
) -> DataFrame:
    """(keys, model, mae, rmse, mape, status) on each series' last part, one row for every member asked for.

    Every test row counts: ``horizon`` is the longest test part, and a shorter
    one given is refused. A member that gave no prediction for a series, says
    itself that it could not fit it, or a series with fewer than ``min_test``
    test rows, is reported as failed rather than scored by default.
    """
    df = settle(df)  # read by every member and by the comparison
    train, test = split_parts(df, keys, share=share)
    horizon = _reach(test, horizon)
    predicted = forecast_members(train, members, keys, horizon).where("status = 'success'").select(*keys, "model", "step", "yhat")
    pairs = match(test.select(*keys, "step", "y"), predicted, [*keys, "step"])
    scored = metrics.forecast_metrics(pairs, [*keys, "model"]).select(*keys, "model", "n", "mae", "rmse", "mape")
    asked = df.select(*keys).distinct() if keys else df.agg(F.count("*").alias("_any")).drop("_any")
    listed = asked.withColumn("model", F.explode(F.array(*[F.lit(m) for m in members])))
    joined = attach(listed, scored, [*keys, "model"], "_s")
    good = F.coalesce(F.col("_s.n"), F.lit(0)) >= min_test
    return joined.select(
        *keys,
        "model",
        *[F.when(good, F.col(f"_s.{m}")).alias(m) for m in ("mae", "rmse", "mape")],
        F.when(good, "success").otherwise("failed").alias("status"),
    )


def _reach(test: DataFrame, horizon: int | None) -> int:
    """The longest test part, by one small aggregate; an ``horizon`` that does not reach it is an error."""
    longest = test.agg(F.coalesce(F.max("step"), F.lit(1)).alias("longest")).first().longest
    if horizon is not None and horizon < longest:
        raise ValueError(f"a horizon of {horizon} leaves out test rows, of which a series has {longest}")
    return longest


def _cv_pairs(train: DataFrame, test: DataFrame, members: Mapping[str, Member], keys: Sequence[str], horizon: int | None = None) -> DataFrame:
    by = [*keys, "fold"]
    reach = _reach(test, horizon)
    predicted = forecast_members(settle(train), members, by, reach).select(*by, "model", "step", "yhat")
    return match(test.select(*by, "step", "ts", "y"), predicted, [*by, "step"])


def cross_validate(
    df: DataFrame,
    members: Mapping[str, Member],
    keys: Sequence[str] = (),
    initial: int | None = None,
    horizon: int = 6,
    step: int = 3,
) -> DataFrame:
    """(keys, fold, model, step, ts, y, yhat) of every member refitted on every expanding-window fold.

    The fold is one more key, so all series and folds of a member are fitted by
    one job, in parallel. Score with :func:`crossval.cv_scores` by keys and model.
    """
    df = settle(df)
    train = crossval.fold_train(df, keys, "ts", initial, horizon, step)
    test = crossval.fold_tests(df, keys, "ts", initial, horizon, step)
    return _cv_pairs(train, test.withColumn("step", F.col("idx") - F.col("cut") + 1), members, keys, horizon)


def cross_validate_cutoffs(
    df: DataFrame,
    members: Mapping[str, Member],
    keys: Sequence[str] = (),
    initial: int = 730,
    period: int = 180,
    horizon: int = 365,
    max_step: int | None = None,
) -> DataFrame:
    """The same by calendar cutoffs in days. Every test row counts; a ``max_step`` that would leave some out is refused."""
    df = settle(df)
    train, test = crossval.cutoff_parts(df, keys, "ts", initial, period, horizon)
    return _cv_pairs(train, test, members, keys, max_step)


@dataclass
class FittedPanel:
    """Forecasts and weights of a panel as lazy frames, with parquet persistence."""

    keys: list[str]
    forecasts: DataFrame
    scores: DataFrame | None = None
    weights: DataFrame | None = None

    def combined(self, method: str = "weighted") -> DataFrame:
        if method == "simple" or self.weights is None:
            return ensemble.simple_average(self.forecasts, self.keys)
        return ensemble.weighted_average(self.forecasts, self.weights, self.keys, intervals=True)

    def contributions(self) -> DataFrame:
        if self.scores is None or self.weights is None:
            raise ValueError("members were not scored")
        return ensemble.contributions(self.scores, self.weights, self.keys)

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """Write the tables to a shared folder; reading them back is the hand-off between jobs."""
        for name in ("forecasts", "scores", "weights"):
            frame = getattr(self, name)
            if frame is not None:
                frame.write.mode(mode).parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str, keys: Sequence[str], scored: bool = True) -> "FittedPanel":
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return cls(list(keys), read("forecasts"), read("scores") if scored else None, read("weights") if scored else None)


def fit(
    df: DataFrame,
    members: Mapping[str, Member],
    keys: Sequence[str] = (),
    horizon: int = 12,
    test_horizon: int | None = None,
    min_rows: int = MIN_ROWS,
    scored: bool = True,
) -> FittedPanel:
    """Train the members on every series with at least ``min_rows`` rows and forecast ``horizon`` periods.

    Hold-out parts are scored whole; ``test_horizon`` may state their greatest
    length. Short series are left out here and listed by :func:`series_eligibility`.
    Forecasts that a member gives with another status than success are not kept.
    """
    n = F.count("*").over(per_series(keys))
    ready = settle(df.withColumn("_n", n).where(F.col("_n") >= min_rows).drop("_n"))
    forecasts = forecast_members(ready, members, keys, horizon).where("status = 'success'").drop("status")
    if not scored:
        return FittedPanel(list(keys), forecasts)
    scores = settle(holdout_scores(ready, members, keys, test_horizon))
    return FittedPanel(list(keys), forecasts, scores, ensemble.ensemble_weights(scores, keys))


series_eligibility = crossval.series_eligibility
