"""Validation, profiles and statistics: aggregates only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import attach, by_time, change_rate, correlation, ratio, sample_kurtosis, sample_skewness
from ..functions.ordered import gap_counts
from ..functions.quantiles import bracket_sketch, exact_quantiles
from ..schema import TIME_WORDS, VALUE_WORDS, find_roles
from ..session import settle
from .clean import to_number

# Largest whole-day gap of each frequency code, in order; beyond the last it is yearly.
FREQUENCY_LIMITS = {"D": 1, "W": 7, "M": 31, "Q": 93}


def preview(df: DataFrame, n: int = 50, order: Sequence[str] = ()) -> DataFrame:
    """The first n rows in a stated order (n is the feature: a top-n, never a full sort)."""
    return (df.orderBy(*order) if order else df).limit(n)


def tail_rows(df: DataFrame, n: int = 50, ts: str = "ts") -> DataFrame:
    """The last n rows by time, oldest first."""
    return df.orderBy(F.desc(ts)).limit(n).orderBy(ts)


def shape(df: DataFrame) -> DataFrame:
    """One row: row count, column count, and each column's type as ``name type`` texts."""
    types = [F.lit(f"{f.name} {f.dataType.simpleString()}") for f in df.schema.fields]
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.array(*types).alias("columns")
    )


def validate(
    df: DataFrame, ts: str | None = None, y: str | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """One row per key: validity, missing and duplicate counts, range and basic statistics.

    Duplicates are rows beyond the first of each time, nulls being equal to each
    other. The std is the sample std. Missing roles give ``is_valid = false``
    with the reason, without statistics.
    """
    if ts is None or y is None:
        found_ts, found_y = find_roles([c for c in df.columns if c not in keys])
        ts, y = ts or found_ts, y or found_y
    errors = []
    if ts is None:
        errors.append("no time column; expected a name with one of " + ", ".join(TIME_WORDS))
    if y is None:
        errors.append("no value column; expected a name with one of " + ", ".join(VALUE_WORDS))
    texts = F.array(*[F.lit(e) for e in errors]).cast("array<string>")
    if errors:
        return df.groupBy(*keys).agg(F.count("*").alias("total_records")).select(
            *keys, "total_records", F.lit(False).alias("is_valid"), texts.alias("errors")
        )
    value = to_number(y)
    counted = df.groupBy(*keys).agg(
        F.count("*").alias("total_records"),
        F.count_if(F.col(ts).isNull()).alias("missing_dates"),
        F.count_if(F.col(y).isNull()).alias("missing_values"),
        F.count_distinct(F.col(ts)).alias("_times"),
        F.min(ts).alias("start_date"),
        F.max(ts).alias("end_date"),
        F.avg(value).alias("mean_value"),
        F.stddev_samp(value).alias("std_value"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
    )
    null_group = F.when(F.col("missing_dates") > 0, 1).otherwise(0)
    checked = counted.withColumn(
        "duplicate_dates", F.col("total_records") - F.col("_times") - null_group
    ).drop("_times")

    def note(name: str, text: str) -> Column:
        return F.when(F.col(name) > 0, F.concat(F.lit("found "), F.col(name).cast("string"), F.lit(" " + text)))

    notes = F.filter(
        F.array(
            note("missing_dates", "missing dates"),
            note("missing_values", "missing values"),
            note("duplicate_dates", "duplicate dates"),
        ),
        lambda n: n.isNotNull(),
    )
    empty = F.col("total_records") == 0
    return checked.withColumns(
        {
            "is_valid": ~empty,
            "errors": F.when(empty, F.array(F.lit("table is empty"))).otherwise(texts),
            "warnings": notes,
        }
    )


def detect_frequency(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", block: str = "month") -> DataFrame:
    """D/W/M/Q/Y from the commonest gap between successive distinct times; ties go to the smallest gap.

    A key with fewer than two times has no gap and counts as monthly. One pass over the rows.
    """
    gap = F.when(F.col("seconds").isNotNull(), F.struct(F.col("n"), -F.col("seconds")))
    modal = gap_counts(df, keys, ts, block).groupBy(*keys).agg(
        F.coalesce(F.sum("n_obs"), F.lit(0)).alias("n_obs"), F.floor(F.max_by("seconds", gap) / 86400).alias("modal_days")
    )
    code = F.lit("Y")
    for name, limit in reversed(FREQUENCY_LIMITS.items()):
        code = F.when(F.col("modal_days") <= limit, F.lit(name)).otherwise(code)
    return modal.select(*keys, "n_obs", "modal_days", F.when(F.col("modal_days").isNull(), F.lit("M")).otherwise(code).alias("frequency"))


def _moments(df: DataFrame, keys: Sequence[str], ts: str, y: str, extra: Sequence[Column] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.min(ts).alias("start_ts"),
        F.max(ts).alias("end_ts"),
        F.avg(y).alias("mean"),
        F.stddev_samp(y).alias("std"),
        F.min(y).alias("min"),
        F.max(y).alias("max"),
        F.count_if(F.col(y).isNull()).alias("missing_values"),
        F.count_if(F.col(y) == 0).alias("zero_values"),
        *extra,
    )


QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def _quartiles(df: DataFrame, keys: Sequence[str], y: str, scale: str, accuracy: int, sketch: DataFrame | None) -> DataFrame:
    names, probs = list(QUARTILES), list(QUARTILES.values())
    if scale == "rows":
        return exact_quantiles(df, keys, y, probs, names=names, accuracy=accuracy, sketch=sketch)
    if scale == "series":
        return df.groupBy(*keys).agg(*[F.percentile(y, F.lit(p)).alias(n) for n, p in zip(names, probs)])
    if scale == "approx":
        return df.groupBy(*keys).agg(*[F.percentile_approx(y, p, accuracy).alias(n) for n, p in zip(names, probs)])
    raise ValueError(f"unknown scale {scale!r}; one of rows, series, approx")


def summary(
    df: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "ts",
    y: str = "y",
    scale: str = "rows",
    accuracy: int = 10_000,
    block: str = "month",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Shape, range, mean/std/min/max, quartiles, frequency, missing and zero counts per key.

    ``scale`` picks the quantiles: ``rows`` exact for any size, ``series`` exact
    for frames already reduced to periods, ``approx`` a sketch. Exact quantiles
    of rows read the table three times: for moments and the sketch together,
    for the values near the wanted ranks, and for the distinct times.
    """
    sketch = bracket_sketch(y, list(QUARTILES.values()), accuracy) if scale == "rows" else []
    facts = _moments(df, keys, ts, y, [*extra, *sketch])
    columns = [c for c in facts.columns if c not in ("edges", "size")]
    if sketch:
        facts = settle(facts)
    near = facts.select(*keys, "edges", "size") if sketch else None
    with_q = attach(facts.select(*columns), _quartiles(df, keys, y, scale, accuracy, near), keys, "_q")
    full = attach(with_q, detect_frequency(df, keys, ts, block), keys, "_f")
    return full.select(
        *columns,
        *[F.col(f"_q.{n}").alias(n) for n in ("q25", "median", "q75")],
        F.col("_f.frequency").alias("frequency"),
    )


def distribution_stats(
    df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y", scale: str = "rows", **options
) -> DataFrame:
    """:func:`summary` plus bias-corrected skewness and excess kurtosis, and the sample variance."""
    shape_of = (
        sample_skewness(y).alias("skewness"),
        sample_kurtosis(y).alias("kurtosis"),
        F.var_samp(y).alias("variance"),
    )
    return summary(df, keys, ts, y, scale, extra=shape_of, **options)


def yoy_growth(
    df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y", period: int = 12
) -> DataFrame:
    """Mean, sample std and latest of the change against ``period`` rows earlier, on a reduced series."""
    g = change_rate(F.col(y), F.lag(y, period).over(by_time(keys, ts)))
    return (
        df.select(*keys, ts, g.alias("_g"))
        .groupBy(*keys)
        .agg(
            F.count("_g").alias("n_growth"),
            F.avg("_g").alias("mean_yoy_growth"),
            F.stddev_samp("_g").alias("std_yoy_growth"),
            F.max_by("_g", F.when(F.col("_g").isNotNull(), F.col(ts))).alias("latest_yoy_growth"),
        )
    )


def seasonal_profile(
    df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y", part: str = "month"
) -> DataFrame:
    """Mean, sample std and count of each calendar month or quarter."""
    parts = {"month": F.month, "quarter": F.quarter}
    if part not in parts:
        raise ValueError(f"unknown part {part!r}; one of {sorted(parts)}")
    return df.groupBy(*keys, parts[part](ts).alias(part)).agg(
        F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.count(y).alias("n")
    )


def seasonality_strength(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y") -> DataFrame:
    """Peak and trough month (ties to the lowest month) and std/mean of the monthly means."""
    means = seasonal_profile(df, keys, ts, y, "month")
    return means.groupBy(*keys).agg(
        F.max_by("month", F.struct(F.col("mean"), -F.col("month"))).alias("peak_month"),
        F.min_by("month", F.struct(F.col("mean"), F.col("month"))).alias("trough_month"),
        ratio(F.stddev_samp("mean"), F.avg("mean")).alias("seasonality_strength"),
    )


def yearly_growth(
    df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", y: str = "y", min_years: int = 3
) -> DataFrame:
    """Yearly means and their change; series with fewer than ``min_years`` years give no rows."""
    years = df.groupBy(*keys, F.year(ts).alias("year")).agg(F.avg(y).alias("year_mean"))
    w = Window.partitionBy(*keys).orderBy("year")
    n_years = F.count("*").over(Window.partitionBy(*keys))
    return (
        years.withColumns({"year_growth": change_rate(F.col("year_mean"), F.lag("year_mean").over(w)), "_n": n_years})
        .where(F.col("_n") >= min_years)
        .drop("_n")
    )


def quality_report(df: DataFrame, duplicates: bool = True) -> DataFrame:
    """One row per column with missing count, type and numeric range, beside the table's totals.

    Score = max(0, 100 - 50 * missing cells / cells). A cell is missing when
    null or the empty string. All columns are measured in one pass; counting
    duplicate rows needs a grouping of whole rows, and can be turned off.
    """
    parts: list[Column] = [F.count("*").alias("_rows")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f.name)
        is_text = isinstance(f.dataType, T.StringType)
        present = c.isNotNull() & (c != "") if is_text else c.isNotNull()
        countable = is_text or isinstance(f.dataType, T.NumericType)
        number = to_number(f.name) if countable else F.lit(None).cast("double")
        parts.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.count_if(~present).alias("missing"),
                F.min(number).alias("min_value"),
                F.max(number).alias("max_value"),
                F.avg(number).alias("mean_value"),
            ).alias(f"_c{i}")
        )
    n = len(df.columns)
    measured = df.agg(*parts)
    missing = sum((F.col(f"_c{i}.missing") for i in range(n)), F.lit(0))
    table = measured.select(
        F.col("_rows").alias("total_records"),
        missing.alias("missing_total"),
        F.greatest(F.lit(0.0), 100 - F.coalesce(ratio(missing * 50.0, F.col("_rows") * n), F.lit(100.0))).alias(
            "quality_score"
        ),
        F.explode(F.array(*[f"_c{i}" for i in range(n)])).alias("_col"),
    ).select("total_records", "missing_total", "quality_score", "_col.*")
    if not duplicates:
        return table
    copies = df.groupBy(*df.columns).agg((F.count("*") - 1).alias("_extra")).agg(
        F.coalesce(F.sum("_extra"), F.lit(0)).alias("duplicate_records")
    )
    return table.withColumn("duplicate_records", copies.scalar())


# ---- correlations --------------------------------------------------------------

def numeric_columns(df: DataFrame, leave_out: Sequence[str] = ()) -> list[str]:
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in leave_out
    ]


def feature_importance(
    df: DataFrame, target: str = "y", keys: Sequence[str] = (), features: Sequence[str] | None = None
) -> DataFrame:
    """(keys, feature, importance): absolute correlation with the target, all features in one pass.

    A constant feature has no correlation and gets null.
    """
    names = list(features or numeric_columns(df, (*keys, target)))
    wide = df.groupBy(*keys).agg(
        *[F.abs(correlation(n, target)).alias(n) for n in names]
    )
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("importance")) for n in names])
    return wide.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.feature", "_p.importance")


def top_k_features(
    df: DataFrame, target: str = "y", k: int = 20, keys: Sequence[str] = (), features: Sequence[str] | None = None
) -> DataFrame:
    """The k features with the largest importance per key, ranked; equal to nine places, the name decides."""
    scored = feature_importance(df, target, keys, features)
    order = Window.partitionBy(*keys).orderBy(F.round("importance", 9).desc_nulls_last(), "feature")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# Name fragments of each feature family.
FEATURE_FAMILIES = {
    "lag_features": ("lag",),
    "rolling_features": ("rolling",),
    "seasonal_features": ("month", "quarter", "seasonal"),
    "trend_features": ("trend",),
    "statistical_features": ("growth", "volatility", "ma_"),
}


def correlation_report(
    df: DataFrame, target: str = "y", k: int = 15, keys: Sequence[str] = (), features: Sequence[str] | None = None
) -> DataFrame:
    """Top-k correlations with their families and strength (strong > 0.7, weak < 0.3)."""
    top = top_k_features(df, target, k, keys, features)
    name = F.lower("feature")

    def belongs(words: Sequence[str]) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | name.contains(w)
        return hit

    families = F.filter(
        F.array(*[F.when(belongs(words), F.lit(label)) for label, words in FEATURE_FAMILIES.items()]),
        lambda f: f.isNotNull(),
    )
    strength = F.when(F.col("importance") > 0.7, "strong").when(F.col("importance") < 0.3, "weak").otherwise("medium")
    return top.withColumns({"families": families, "strength": strength})


def correlation_matrix(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, left, right, corr) for every ordered pair of the given columns, in one pass."""
    cols = list(columns)
    cells = []
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            cells.append((a, cols[j], f"_p{i}_{j}"))
    wide = df.groupBy(*keys).agg(
        *[correlation(a, b).alias(n) for a, b, n in cells]
    )
    entries = []
    for a, b, n in cells:
        for left, right in ((a, b),) if a == b else ((a, b), (b, a)):
            entries.append(
                F.struct(F.lit(left).alias("left"), F.lit(right).alias("right"), F.col(n).alias("corr"))
            )
    return wide.select(*keys, F.explode(F.array(*entries)).alias("_e")).select(*keys, "_e.*")
