"""Typing, cleaning and row-level preparation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import known, match, per_series
from ..functions.ordered import carry_fill
from ..schema import require_roles

# Text layouts tried in turn for a time column.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy-MM", "yyyy/MM/dd", "MM/dd/yyyy")

# Months kept by each trailing range; None keeps everything.
TRAILING_MONTHS = {"6M": 6, "1Y": 12, "2Y": 24, "All": None}


def parse_time(df: DataFrame, name: str, formats: Sequence[str] = TIME_FORMATS) -> Column:
    """The column as TIMESTAMP_NTZ; text that fits no format becomes null."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.col(name).cast("timestamp_ntz")
    text = F.trim(F.col(name).cast("string"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def to_number(c: str | Column) -> Column:
    """The value as DOUBLE; text that is no number, and NaN, become null."""
    value = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(value), value)


def _reduced(
    df: DataFrame, keys: Sequence[str], ts: str, y: str, seq: str | Sequence[str] | None, formats: Sequence[str], block: str | None
) -> DataFrame:
    """One row per (keys, time): last present value, fill applied, counts kept for the report.

    Filling in time order and then keeping the last row of each time equals
    keeping the last present value of each time and then filling (leading gaps
    from the first present value of the next time), so the duplicates are
    collapsed, with map-side partial aggregation, before any ordering happens.
    Unparsable times form one null group per key.
    """
    extras = [c for c in df.columns if c not in (*keys, ts, y)]
    order = [seq] if isinstance(seq, str) else list(seq or [])
    typed = df.select(
        *keys, parse_time(df, ts, formats).alias("ts"), F.col(y).alias("_raw"), *extras
    )
    # without a sequence column the rest of the row breaks ties, so that runs agree
    place = F.struct(*order) if order else F.xxhash64("_raw", *extras)
    present = F.when(F.col("_raw").isNotNull(), place)
    grouped = typed.groupBy(*keys, "ts").agg(
        F.max_by("_raw", present).alias("_value"),
        F.min_by("_raw", present).alias("_first"),
        *([F.max_by(F.struct(*extras), place).alias("_extras")] if extras else []),
        F.count("*").alias("_rows"),
        F.count_if(F.col("_raw").isNull()).alias("_missing"),
    )
    known = F.col("ts").isNotNull()
    timed = grouped.withColumns({c: F.when(known, F.col(c)) for c in ("_value", "_first")})
    if block:
        filled = carry_fill(timed, keys, ["ts"], "_value", block, ahead="_first")
    else:
        w = Window.partitionBy(*keys).orderBy("ts")
        filled = timed.withColumn(
            "_value",
            F.coalesce(
                F.last("_value", True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                F.first("_first", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
            ),
        )
    return filled.withColumn("y", to_number("_value"))


def clean(
    df: DataFrame,
    keys: Sequence[str] = (),
    ts: str | None = None,
    y: str | None = None,
    seq: str | Sequence[str] | None = None,
    formats: Sequence[str] = TIME_FORMATS,
    block: str | None = "month",
) -> DataFrame:
    """Raw table -> canonical panel (keys, ts, y, other columns).

    Roles are found by name unless given. Bad times are dropped, missing values
    filled forward then backward in time order, each time keeps its last row
    (by ``seq``), values that are no numbers are dropped. Idempotent.
    """
    if ts is None or y is None:
        ts, y = require_roles([c for c in df.columns if c not in keys])
    extras = [c for c in df.columns if c not in (*keys, ts, y)]
    reduced = _reduced(df, keys, ts, y, seq, formats, block)
    good = reduced.where(F.col("ts").isNotNull() & F.col("y").isNotNull())
    return good.select(*keys, "ts", "y", *[F.col(f"_extras.{c}").alias(c) for c in extras])


def clean_report(
    df: DataFrame,
    keys: Sequence[str] = (),
    ts: str | None = None,
    y: str | None = None,
    seq: str | Sequence[str] | None = None,
    formats: Sequence[str] = TIME_FORMATS,
    block: str | None = "month",
) -> DataFrame:
    """What :func:`clean` did, one row per key, in one aggregate over the same plan."""
    if ts is None or y is None:
        ts, y = require_roles([c for c in df.columns if c not in keys])
    order = [seq] if isinstance(seq, str) else list(seq or [])
    reduced = _reduced(df, keys, ts, y, order, formats, block)  # all columns, as in clean: without seq they break ties
    timed = F.col("ts").isNotNull()
    return reduced.groupBy(*keys).agg(
        F.sum("_rows").alias("rows_in"),
        F.coalesce(F.sum(F.when(~timed, F.col("_rows"))), F.lit(0)).alias("invalid_dates"),
        F.coalesce(F.sum(F.when(timed, F.col("_missing"))), F.lit(0)).alias("missing_filled"),
        F.coalesce(F.sum(F.when(timed, F.col("_rows") - 1)), F.lit(0)).alias("duplicates_removed"),
        F.count_if(timed & F.col("y").isNull()).alias("non_numeric_removed"),
        F.count_if(timed & F.col("y").isNotNull()).alias("rows_out"),
    )


def fill_missing(
    df: DataFrame, keys: Sequence[str], ts: str, y: str, seq: Sequence[str] = (), block: str = "month", out: str | None = None
) -> DataFrame:
    """Forward then backward fill per key in (ts, seq) order, every row kept."""
    return carry_fill(df, keys, [ts, *seq], y, block, out)


def dedupe_last(df: DataFrame, by: Sequence[str], seq: str | Sequence[str]) -> DataFrame:
    """Keep the row with the largest ``seq`` for each value of ``by``; a plain aggregate, no window."""
    order = [seq] if isinstance(seq, str) else list(seq)
    rest = [c for c in df.columns if c not in by]
    last = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return last.select(*[F.col(c) if c in by else F.col(f"_row.{c}").alias(c) for c in df.columns])


def drop_empty_rows(df: DataFrame, blank_is_empty: bool = False) -> DataFrame:
    """Drop rows whose every cell is null or the empty string (or blank, if asked)."""
    def present(name: str) -> Column:
        c = F.col(name)
        if isinstance(df.schema[name].dataType, T.StringType):
            return c.isNotNull() & ((F.trim(c) if blank_is_empty else c) != "")
        return c.isNotNull()

    keep = F.lit(False)
    for name in df.columns:
        keep = keep | present(name)
    return df.where(keep)


def convert_types(df: DataFrame, kinds: Mapping[str, str], formats: Sequence[str] = TIME_FORMATS) -> DataFrame:
    """Convert the named columns to number, date, boolean or string; what cannot be converted is null."""
    out: dict[str, Column] = {}
    for name, kind in kinds.items():
        if name not in df.columns:
            continue
        if kind == "number":
            out[name] = to_number(name)
        elif kind == "date":
            out[name] = parse_time(df, name, formats)
        elif kind == "boolean":
            # The texts that mean true; everything else is false.
            out[name] = F.coalesce(F.lower(F.col(name).cast("string")).isin("true", "1"), F.lit(False))
        elif kind == "string":
            out[name] = F.col(name).cast("string")
        else:
            raise ValueError(f"unknown kind {kind!r} for column {name!r}")
    return df.withColumns(out)


def trailing_range(df: DataFrame, span: str, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Rows of a reduced series within the last months of its key: 6M, 1Y, 2Y or All."""
    if span not in TRAILING_MONTHS:
        raise ValueError(f"unknown range {span!r}; one of {sorted(TRAILING_MONTHS)}")
    months = TRAILING_MONTHS[span]
    if months is None:
        return df
    last = F.max(F.to_date(ts)).over(per_series(keys))
    return (
        df.withColumn("_from", F.add_months(last, -months)).where(F.to_date(ts) > F.col("_from")).drop("_from")
    )


def align_pairs(actual: DataFrame, predicted: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """(keys, ts, y) joined with (keys, ts, …, yhat) on key and time; pairs with a null or NaN are dropped, null keys match."""
    return match(actual, predicted, [*keys, ts]).where(known("y") & known("yhat"))


# ---- named steps -----------------------------------------------------------

@dataclass
class StepResult:
    """Outcome of one named step; ``rows`` is known once the final frame has been used."""

    name: str
    success: bool
    error: str | None = None
    observation: Observation | None = None

    @property
    def rows(self) -> int | None:
        return self.observation.get["rows"] if self.observation else None


def run_steps(
    df: DataFrame, steps: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]
) -> tuple[DataFrame, list[StepResult]]:
    """Chain named DataFrame steps; stop at the first that cannot be planned.

    Row counts per step are observed while the final frame is computed, so they
    cost no extra job.
    """
    results: list[StepResult] = []
    for name, step in steps:
        try:
            seen = Observation(name)
            df = step(df).observe(seen, F.count(F.lit(1)).alias("rows"))
            results.append(StepResult(name, True, observation=seen))
        except Exception as exc:  # a failing step ends the chain and is reported
            results.append(StepResult(name, False, error=str(exc)))
            break
    return df, results
