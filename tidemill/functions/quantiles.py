"""Exact quantiles of columns too large for one task.

Spark's exact ``percentile`` keeps a value -> count map per group in one task,
which is right for a series already reduced to periods and wrong for raw rows.
Here a mergeable sketch first brackets each wanted rank; one pass then counts
everything outside the brackets in a handful of groups and keeps only values
inside them, about ``8 / accuracy`` of the rows per probability however the
keys are skewed. Those are ordered in slots by many tasks, with one total per slot
carried across. The answer is exact: if a sketch ever missed its rank the job
fails instead of returning a wrong value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .columns import attach, per_series

# Fixed value: slots a bracket is cut into, so that its values are ordered by many tasks.
SLOTS = 256


def bracket_edges(probs: Sequence[float], accuracy: int) -> list[float]:
    """The probabilities whose approximate quantiles bracket each of ``probs``."""
    slack = 4.0 / accuracy
    return [min(max(p + s, 0.0), 1.0) for p in sorted(set(probs)) for s in (-slack, slack)]


def bracket_sketch(value: str, probs: Sequence[float], accuracy: int) -> list[Column]:
    """Aggregates ``edges`` and ``size`` of :func:`exact_quantiles`, to be taken in a pass that is made anyway."""
    v = F.col(value).cast("double")
    return [F.percentile_approx(v, bracket_edges(probs, accuracy), accuracy).alias("edges"), F.count(v).alias("size")]


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    rule: str = "linear",
    accuracy: int = 10_000,
    names: Sequence[str] | None = None,
    sketch: DataFrame | None = None,
) -> DataFrame:
    """One row per key with the quantiles of ``value`` (nulls ignored).

    ``sketch`` (keys, edges, size: :func:`bracket_sketch`, kept) saves a pass if there is one already.

    ``rule``: ``linear`` interpolates between ranks, ``floor`` takes the sorted
    value at index ``floor(n * p)``. Raise ``accuracy`` with the size of a key:
    an ordering task holds about ``8 n / accuracy / SLOTS`` distinct values, or
    the whole key while n is at most ``accuracy``.
    """
    if rule not in ("linear", "floor"):
        raise ValueError(f"unknown rule {rule!r}")
    names = list(names or [f"q{int(round(p * 100)):02d}" for p in probs])
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())

    brackets = sorted(set(probs))
    # one row per key, kept: merging a sketch again could move its edges, and a retried task must see the same ones
    if sketch is None:
        sketch = rows.groupBy(*keys).agg(*bracket_sketch("_v", probs, accuracy))
        sketch = sketch if keys else settle(sketch)
    near = attach(rows, sketch, keys, "_s", raw=True)

    # every value gets a slot, and slots are disjoint intervals: one per gap between brackets, many inside a bracket
    v, whole = F.col("_v"), F.col("_s.size") <= accuracy
    inside, slot = F.lit(False), -1 - sum((v > F.col("_s.edges")[2 * i + 1]).cast("int") for i in range(len(brackets)))
    for i in reversed(range(len(brackets))):
        low, high = F.col("_s.edges")[2 * i], F.col("_s.edges")[2 * i + 1]
        place = F.floor(F.coalesce(F.try_divide(v - low, high - low), F.lit(0.0)) * SLOTS).cast("int")
        here = v.between(low, high)
        inside = inside | here
        slot = F.when(here, F.lit(i * (SLOTS + 1)) + place).otherwise(slot)
    # a bracket narrower than a few ranks proves nothing, so small keys (bounded by accuracy) are kept whole
    cells = (
        near.select(*keys, "_v", F.when(inside | whole, v).alias("_kept"), F.when(whole, 0).otherwise(slot).alias("_slot"))
        .groupBy(*keys, "_kept", "_slot")
        .agg(F.count("*").alias("_n"), F.min("_v").alias("_at"))
    )
    upto = Window.partitionBy(*keys, "_slot").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    running = cells.withColumn("_run", F.sum("_n").over(upto))
    slots = cells.groupBy(*keys, "_slot").agg(F.sum("_n").alias("_m"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slots.select(
        *keys,
        "_slot",
        F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("before"),
        F.sum("_m").over(per_series(keys)).alias("total"),
    )
    ranked = attach(running, offsets, [*keys, "_slot"], "_o").withColumns(
        {"_end": F.col("_run") + F.col("_o.before"), "_total": F.col("_o.total")}
    )

    def value_at(rank: Column) -> Column:
        hit = (rank >= F.col("_end") - F.col("_n")) & (rank < F.col("_end"))
        return F.max(F.when(hit, F.coalesce("_kept", F.raise_error(F.lit("quantile bracket missed its rank")))))

    aggs = []
    for p, name in zip(probs, names):
        if rule == "floor":
            rank = F.least(F.floor(F.col("_total") * F.lit(p)), F.col("_total") - 1)
            aggs.append(value_at(rank).alias(name))
        else:
            at = (F.col("_total") - 1) * F.lit(p)
            low, high = value_at(F.floor(at)), value_at(F.ceil(at))
            part = F.max(at - F.floor(at))
            aggs.append((low + (high - low) * part).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def series_quantile(value: str | Column, prob: float, keys: Sequence[str]) -> Column:
    """Exact quantile over a whole series, for frames already reduced to periods."""
    return F.percentile(value, F.lit(prob)).over(per_series(keys))
