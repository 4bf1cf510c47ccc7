"""Column expressions shared by the operators.

Conventions: division by zero gives null (``try_divide``); ``sample`` standard
deviations use n-1, ``population`` ones n, and each caller states which.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import settle

FREQUENCIES = ("D", "W", "M", "Q", "Y")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def by_time(keys: Sequence[str], ts: str | Column = "ts") -> WindowSpec:
    """One ordered window per series. Only for frames already reduced to periods."""
    return Window.partitionBy(*keys).orderBy(ts)


def per_series(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def change_rate(y: Column, before: Column) -> Column:
    """Relative change against an earlier value."""
    return ratio(y - before, before)


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over complete pairs, null where either side does not vary."""
    x, y = col(x).cast("double"), col(y).cast("double")
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def full_frame(
    fn: Callable[[Column], Column], y: Column, order: WindowSpec, first: int, last: int
) -> Column:
    """``fn(y)`` over rows first..last, null unless every row of the frame holds a value."""
    frame = order.rowsBetween(first, last)
    return F.when(F.count(y).over(frame) == last - first + 1, fn(y).over(frame))


def trailing(fn: Callable[[Column], Column], y: Column, order: WindowSpec, n: int, back: int = 0) -> Column:
    """``fn(y)`` over the last n rows, ending ``back`` rows before the current one."""
    return full_frame(fn, y, order, -(n - 1) - back, -back)


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows without any null.

    One condition per column: the optimizer derives facts from each alone,
    where the single many-column test of ``na.drop`` makes it try every
    combination of column aliases.
    """
    keep = F.lit(True)
    for c in df.columns:
        keep = keep & F.col(c).isNotNull()
    return df.where(keep)


# ---- calendar ------------------------------------------------------------

def period_start(ts: str | Column, freq: str) -> Column:
    d = F.to_date(col(ts))
    if freq == "D":
        return d
    if freq == "W":
        return F.to_date(F.trunc(d, "week"))
    if freq == "M":
        return F.to_date(F.trunc(d, "month"))
    if freq == "Q":
        return F.to_date(F.trunc(d, "quarter"))
    if freq == "Y":
        return F.to_date(F.trunc(d, "year"))
    raise ValueError(f"unsupported frequency {freq!r}; one of {FREQUENCIES}")


def shift_periods(d: Column, freq: str, n: int | Column) -> Column:
    """The date n periods after a period start (or a month end, for month based steps)."""
    n = F.lit(n) if isinstance(n, int) else n
    n = n.cast("int")
    if freq == "D":
        return F.date_add(d, n)
    if freq == "W":
        return F.date_add(d, n * 7)
    if freq in ("M", "Q", "Y"):
        return F.add_months(d, n * {"M": 1, "Q": 3, "Y": 12}[freq])
    raise ValueError(f"unsupported frequency {freq!r}; one of {FREQUENCIES}")


def period_step(freq: str) -> Column:
    # The calendar step of each frequency.
    steps = {"D": "1 day", "W": "7 days", "M": "1 month", "Q": "3 months", "Y": "1 year"}
    if freq not in steps:
        raise ValueError(f"unsupported frequency {freq!r}; one of {FREQUENCIES}")
    return F.expr(f"interval {steps[freq]}")


def period_end(ts: str | Column, freq: str) -> Column:
    """Last day of the period; weeks end on Sunday."""
    start = period_start(ts, freq)
    return start if freq == "D" else F.date_sub(shift_periods(start, freq, 1), 1)


def clock_seconds(ts: str | Column) -> Column:
    """Seconds since 1970 by the wall clock of a time without zone, whatever the session's zone."""
    t = col(ts).cast("timestamp_ntz")
    day = F.unix_date(F.to_date(t)).cast("bigint")
    return day * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


# ---- shape of a distribution ----------------------------------------------

def sample_skewness(y: str | Column) -> Column:
    """Bias-corrected skewness (needs three values)."""
    n = F.count(col(y)).cast("double")
    return F.when(n > 2, F.skewness(col(y)) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(y: str | Column) -> Column:
    """Bias-corrected excess kurtosis (needs four values)."""
    n = F.count(col(y)).cast("double")
    return F.when(
        n > 3, ((n + 1) * F.kurtosis(col(y)) + 6) * (n - 1) / ((n - 2) * (n - 3))
    )


# ---- spreading heavy groups -------------------------------------------------

def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash the rows over the session's shuffle width before a compute-heavy grouped step.

    Such groups are small in bytes, so left alone adaptive execution would pack
    many into one task; a stated width is kept, and the grouping reuses it.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width, *keys) if keys else df


# ---- attaching aggregates to rows -------------------------------------------

# Fixed value: most key rows that are broadcast. Each holds a few numbers, so this stays far below 100 MB.
BROADCAST_ROWS = 200_000


def small_side(facts: DataFrame) -> DataFrame:
    """The facts computed once and, when counted to be few, marked for broadcast.

    Spark cannot know the size of an aggregate beforehand and would shuffle the
    raw rows to meet it. Beyond the bound the join stays Spark's to plan.
    """
    kept = settle(facts)
    if kept.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return kept
    return F.broadcast(kept)


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join on ``keys`` in which null keys match each other; the key columns are the left ones."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def known(c: str | Column) -> Column:
    """Whether a number is neither null nor NaN."""
    c = col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c)


def attach(df: DataFrame, facts: DataFrame, keys: Sequence[str], name: str, raw: bool = False) -> DataFrame:
    """Put each key's aggregate row beside its rows, as struct column ``name``.

    Without keys the single aggregate row comes in as a scalar subquery. With
    keys it is an equi-join; its strategy is Spark's, which splits a hot key,
    except that for ``raw`` rows facts of checked size are broadcast
    (:func:`small_side`). Null keys match each other.
    """
    fields = [c for c in facts.columns if c not in keys]
    held = small_side(facts) if raw and keys else facts
    packed = held.select(*keys, F.struct(*fields).alias(name))
    if not keys:
        return df.withColumn(name, packed.scalar())
    renamed = packed.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = [df[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
    return df.join(renamed, condition, "left").drop(*[f"__{k}" for k in keys])
