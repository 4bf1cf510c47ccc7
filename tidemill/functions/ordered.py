"""Ordered operations on raw rows without sending a whole key to one task.

A time-ordered window over a raw key would put every row of a hot key in one
task. These helpers cut each key into time blocks, work inside the blocks, and
carry only one summary row per block across them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import attach, clock_seconds

UNBOUNDED_BEFORE = Window.unboundedPreceding
UNBOUNDED_AFTER = Window.unboundedFollowing


def carry_fill(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    y: str,
    block: str = "month",
    out: str | None = None,
    ahead: str | None = None,
) -> DataFrame:
    """Fill nulls of ``y`` with the previous value in order, leading ones with the next.

    ``order[0]`` is the time column that the blocks are cut from; ``block`` is
    any ``date_trunc`` unit and changes only the size of the tasks, never the
    result. ``ahead`` names another column to take the backward value from, in
    the first row that has ``y``. Leading rows of a key all get that one value,
    so no frame looks ahead: Spark would go through the rest of the block again for every row.
    """
    ahead = ahead or y
    keys = list(keys)
    blocked = df.withColumn("_block", F.date_trunc(block, F.col(order[0])))
    inner = Window.partitionBy(*keys, "_block").orderBy(*order)
    marked = blocked.withColumn("_back", F.last(y, True).over(inner.rowsBetween(UNBOUNDED_BEFORE, 0)))
    present = F.when(F.col(y).isNotNull(), F.struct(*order))
    blocks = blocked.groupBy(*keys, "_block").agg(
        F.max_by(y, present).alias("_tail"),
        F.min_by(ahead, present).alias("_head"),
    )
    across = Window.partitionBy(*keys).orderBy("_block")
    carried = blocks.select(
        *keys,
        "_block",
        F.last("_tail", True).over(across.rowsBetween(UNBOUNDED_BEFORE, -1)).alias("before"),
        F.first("_head", True).over(across.rowsBetween(UNBOUNDED_BEFORE, UNBOUNDED_AFTER)).alias("head"),
    )
    joined = attach(marked, carried, [*keys, "_block"], "_c", raw=True)
    filled = F.coalesce("_back", F.col("_c.before"), F.col("_c.head"))
    return joined.withColumn(out or y, filled).drop("_block", "_back", "_c")


def gap_counts(df: DataFrame, keys: Sequence[str], ts: str, block: str = "month") -> DataFrame:
    """(keys, seconds, n, n_obs): how often each gap occurs between successive distinct times, and rows with a time.

    One pass over the rows: they are reduced to distinct times, those to gaps
    within a block and the ends of the block, and those to counts, before the
    few that are left of a key meet. The row with null ``seconds`` stands for
    no gap: it carries the rest of ``n_obs``.
    """
    keys = list(keys)
    times = df.groupBy(*keys, F.col(ts).alias("_t")).agg(F.count(ts).alias("_m")).withColumn("_block", F.date_trunc(block, "_t"))
    inner = Window.partitionBy(*keys, "_block").orderBy("_t")
    marked = times.withColumns({"_p": F.lag("_t").over(inner), "_last": F.lead("_t").over(inner).isNull()})
    first, none = F.col("_p").isNull(), F.lit(None)
    gap = F.struct((clock_seconds("_t") - clock_seconds("_p")).alias("seconds"), none.cast("timestamp").alias("block"), none.cast("bigint").alias("lo"), none.cast("bigint").alias("hi"), F.col("_m").alias("m"))
    at = clock_seconds("_t")
    end = F.struct(
        none.cast("bigint").alias("seconds"), F.col("_block").cast("timestamp").alias("block"), F.when(first, at).alias("lo"), F.when(F.col("_last"), at).alias("hi"), F.when(first, F.col("_m")).otherwise(0).alias("m")
    )
    events = marked.select(*keys, F.explode(F.array_compact(F.array(F.when(~first, gap), F.when(first | F.col("_last"), end)))).alias("_e"))
    sums = events.groupBy(*keys, "_e.seconds", "_e.block").agg(F.count("*").alias("n"), F.min("_e.lo").alias("lo"), F.max("_e.hi").alias("hi"), F.sum("_e.m").alias("m"))
    # gaps come before the blocks, which stand in order: the end of the block before gives the gap between them
    across = Window.partitionBy(*keys).orderBy(F.col("block").asc_nulls_first())
    between = F.when(F.col("block").isNotNull(), F.col("lo") - F.lag("hi").over(across))
    counted = sums.select(*keys, F.coalesce("seconds", between).alias("seconds"), F.when(F.col("seconds").isNull(), 1).otherwise(F.col("n")).alias("n"), "m")
    return counted.groupBy(*keys, "seconds").agg(F.sum("n").alias("n"), F.sum("m").alias("n_obs"))


def gap_days(df: DataFrame, keys: Sequence[str], ts: str, block: str = "month") -> DataFrame:
    """(keys, seconds, n, days): how often each whole-day gap occurs between successive distinct times."""
    gaps = gap_counts(df, keys, ts, block).where("seconds IS NOT NULL").drop("n_obs")
    return gaps.withColumn("days", F.floor(F.col("seconds") / 86400))
