"""Quality rules by robust multivariate outliers, in DataFrame functions alone.

Each text is reduced in its own row to a few counts. Rows that fail the base
rules go. Of the others, transformed statistics form a vector, and each group
of language and source gets a minimum-covariance-determinant estimate of
centre and covariance: from robust centres and scales on, concentration steps
take the share of rows that lie closest and estimate from those alone. Rows
beyond a cutoff of the squared Mahalanobis distance are rejected.

The texts are read once and never shuffled. What is shuffled are aggregates:
sums, and quantiles over values rounded to a grid, which have a bounded number
of distinct values and so combine before the shuffle, however many rows a
group has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import keep, small

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
STATS = ("size", "length", "symbols", "lines", "repeats")
# Least standard deviation of each statistic: a group of copies, or one that lacks something, does not make small differences odd.
# Each is so small that its statistic alone can pass the cutoff among rows that pass the base rules.
FLOORS = (0.8, 0.2, 0.05, 0.15, 0.08)
CUTOFF = 30.0  # of squared distance; beyond it lie under 2 in 10**5 rows of a normal law of five dimensions
MEDIAN_5 = 4.3515  # the median of that law's squared distance
SHARE, STEPS, LEAST_ROWS = 0.75, 3, 200
GRID = 64


def _plain(column: Column, signs: str, to: str = "") -> Column:
    return F.translate(column, signs, to)


def text_counts(docs: DataFrame) -> DataFrame:
    """``docs`` without text and with n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(_plain(text, BLANKS, " " * len(BLANKS)), " ", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda s: F.length(_plain(s, BLANKS)) > 0)
    df = docs.withColumn("words", words).withColumn("lines", lines)
    n = F.size("words")
    # hashes of all five-word windows; the bound keeps the range empty for short texts
    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(1), F.greatest(n - 4, F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, F.lit(5)))))
    df = df.select(
        *[c for c in docs.columns if c != "text"],
        n.cast("bigint").alias("n_words"),
        F.length(_plain(text, BLANKS)).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(_plain(text, SYMBOLS))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(windows, F.array().cast("array<bigint>")).alias("windows"),
    )
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.when(some, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("placed", placed)
    # windows that have a neighbour of the same hash, by place in the text
    again = F.filter(
        "placed",
        lambda s, k: (s["h"] == F.get("placed", k - 1)["h"]).eqNullSafe(True) | (s["h"] == F.get("placed", k + 1)["h"]).eqNullSafe(True),
    )
    places = F.array_sort(F.transform(again, lambda s: s["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
    covered = F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", F.when(F.col("placed").isNull(), F.lit(0)).otherwise(covered).cast("bigint")).drop("windows", "placed")


def _vector() -> list[Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [
        F.log(words.cast("double")),
        F.log1p(chars / words) * 2,
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


def _grid(c: Column) -> Column:
    return F.round(c * GRID) / GRID


def _far(c: str) -> Column:
    """Squared distance on a scale with few distinct values."""
    return _grid(F.log1p(c) * 4)


def _attach(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of a hot group stay where they are: what is known of the groups goes to them."""
    return rows.join(small(facts, "groups"), "group", "left")


def _cholesky(facts: DataFrame) -> DataFrame:
    """Lower factors l_i_j of each group's covariance c_i_j, with the floors added to its diagonal."""
    p = len(STATS)
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}") + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            facts = facts.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 / 100))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return facts.select("group", *[f"m_{i}" for i in range(p)], *[f"l_{i}_{j}" for i in range(p) for j in range(i + 1)])


def _distance(rows: DataFrame, factors: DataFrame) -> DataFrame:
    held = _attach(rows, factors)
    total = F.lit(0.0)
    for i, name in enumerate(STATS):
        rest = F.col(name) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * F.col(f"y_{j}")
        held = held.withColumn(f"y_{i}", rest / F.col(f"l_{i}_{i}"))
        total = total + F.col(f"y_{i}") * F.col(f"y_{i}")
    return held.withColumn("d", total).select(*rows.columns, "d")


def _moments(rows: DataFrame) -> DataFrame:
    p = range(len(STATS))
    return rows.groupBy("group").agg(
        *[F.avg(STATS[i]).alias(f"m_{i}") for i in p],
        *[F.coalesce(F.covar_pop(STATS[i], STATS[j]), F.lit(0.0)).alias(f"c_{i}_{j}") for i in p for j in range(i + 1)],
    )


def _closest(rows: DataFrame, share: float) -> DataFrame:
    limit = rows.groupBy("group").agg(F.percentile(_far("d"), F.lit(share)).alias("limit"))
    return _attach(rows, limit).where(_far("d") <= F.col("limit"))


def mcd_distances(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """``rows`` (group and the statistics) with squared distance d from the group's robust estimate."""
    middle = rows.groupBy("group").agg(*[F.percentile(_grid(F.col(s)), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{s}") for s in STATS])
    start = _attach(rows, middle)
    far = sum(
        (((F.col(s) - F.col(f"q_{s}")[1]) / F.greatest((F.col(f"q_{s}")[2] - F.col(f"q_{s}")[0]) / 1.349, F.lit(f))) ** 2 for s, f in zip(STATS, FLOORS)),
        F.lit(0.0),
    )
    found = start.withColumn("d", far).select(*rows.columns, "d")
    for _ in range(steps):
        found = keep(_distance(found.drop("d"), _cholesky(_moments(_closest(found, share)))), "distances")
    # the closest rows spread less than all: widen until the median is that of a normal law
    wide = found.groupBy("group").agg(F.greatest(F.expm1(F.percentile(_far("d"), F.lit(0.5)) / 4) / MEDIAN_5, F.lit(1.0)).alias("wide"))
    return _attach(found, wide).withColumn("d", F.col("d") / F.col("wide")).drop("wide")


def judge(docs: DataFrame, cutoff: float = CUTOFF, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Each document's counts and verdict.

    ``docs`` has doc_id, text, lang and source; other columns are left out.
    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, distance (squared; null if base_failed) and
    kept. Words, lines and windows are those of the whole text; a null text
    has none and fails. Null languages and sources are groups of their own.
    Groups of fewer than ``least_rows`` rows are judged by the estimate over all such
    groups together. Repeated rows count and are judged each, ties alike.
    """
    return _judged(docs, cutoff, least_rows).drop("row_hash")


def _row_hash() -> Column:
    return F.xxhash64("doc_id", "text", "lang", "source")


def _judged(docs: DataFrame, cutoff: float, least_rows: int) -> DataFrame:
    named = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    counts = text_counts(named.withColumn("row_hash", _row_hash()))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counts = keep(counts.withColumn("base_failed", failed), "counts")
    passed = counts.where("not base_failed")
    sizes = passed.groupBy("lang", "source").agg((F.count(F.lit(1)) >= least_rows).alias("own"))
    group = F.when(F.col("own"), F.to_json(F.array("lang", "source"))).otherwise("the rest")
    sizes = sizes.select(F.col("lang").alias("l"), F.col("source").alias("s"), group.alias("group"))
    sizes = small(sizes, "groups")
    named = passed.join(sizes, passed.lang.eqNullSafe(sizes.l) & passed.source.eqNullSafe(sizes.s), "left").drop("l", "s")
    found = mcd_distances(named.select("*", *[v.alias(s) for v, s in zip(_vector(), STATS)]))
    shown = ["row_hash", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = found.select(*shown, F.col("d").alias("distance"), (F.col("d") <= cutoff).alias("kept"))
    out = counts.where("base_failed").select(*shown, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return judged.unionByName(out)


def keep_good(docs: DataFrame, cutoff: float = CUTOFF, least_rows: int = LEAST_ROWS) -> DataFrame:
    """``docs``, all columns, without the rows that are rejected; equal rows fare alike, and doc_id may be null."""
    good = _judged(docs, cutoff, least_rows).where("kept").select(F.col("row_hash").alias("kept_hash")).distinct()
    own = F.xxhash64(docs["doc_id"], docs["text"], docs["lang"].cast("string"), docs["source"].cast("string"))
    return docs.join(good, own == good["kept_hash"], "left_semi").select(*docs.columns)
