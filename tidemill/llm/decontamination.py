"""Benchmark decontamination: a BM25 index of test items that every passage of the corpus queries.

The index is inverted over the items: per term the share of each item's own
BM25 score that the term brings, and per block of items the largest of them
(block-max). All passages of a slice of texts are queried together in the
manner of WAND: for each block the bounds of a passage's terms are added up,
with the frequent terms, which say little, bounded once for the block; only
blocks whose bound reaches the threshold are scored, exactly. Every item above
the threshold is retrieved, there is no top k. Retrieved pairs are verified on
the words themselves: overlap with the item's question and with its answer.

The items are the small side by nature. They go to the tasks in groups of at
most GROUP_ITEMS, a bounded broadcast; more items mean more passes, not a
larger one. The corpus is never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import Texts, gram_hashes, mix, shingle_sets, texts, word_hashes

K1, B = 1.2, 0.75
BLOCK = 16
SHARD_ITEMS = 256
GROUP_ITEMS = 8192
GROUP_CHARS = 16 << 20
FREQUENT_IDF = 2.0
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
_HIT = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double, first_word bigint, last_word bigint"


def _trimmed(part: Texts) -> Texts:
    """Words without ASCII signs before and after; a word of signs alone is none."""
    starts, ends = part.starts.copy(), part.ends.copy()
    while len(at := np.flatnonzero((starts < ends) & _SIGN[part.data[np.minimum(starts, len(part.data) - 1)]])):
        starts[at] += 1
    while len(at := np.flatnonzero((starts < ends) & _SIGN[part.data[ends - 1]])):
        ends[at] -= 1
    keep = starts < ends
    before = np.concatenate([[0], np.cumsum(keep)])
    return Texts(part.first, part.data, part.offsets, starts[keep], ends[keep], before[part.bounds])


@dataclass
class Shard:
    """Index of some items: terms by hash, shares of scores, block bounds, and what verification needs."""

    items: np.ndarray
    terms: np.ndarray  # sorted hashes
    share: np.ndarray  # terms + 1, items: of an item's own score; the last row is no term
    bound: np.ndarray  # terms + 1, blocks; frequent terms have none
    base: np.ndarray  # by block: what its frequent terms can bring at most
    question: list[np.ndarray]  # sorted shingle hashes
    answer: list[np.ndarray]  # sorted word hashes


def _words(column: list[str | None]) -> list[np.ndarray]:
    out = []
    for part in texts(pa.array(column, pa.string()), lower=True):
        part = _trimmed(part)
        words = word_hashes(part)
        out += [words[b:e] for b, e in zip(part.bounds[:-1], part.bounds[1:])]
    return out


def _grams(column: list[str | None], size: int) -> list[np.ndarray]:
    return [s for part in texts(pa.array(column, pa.string()), lower=True) for s in shingle_sets(_trimmed(part), size)]


def index(items: list[tuple[int, str | None, str | None]], shingle: int = 5) -> tuple[list[Shard], int]:
    """Shards over (item_id, question, answer) and the length of the longest item in words. Items without words are left out."""
    asked, told = _words([x[1] for x in items]), _words([x[2] for x in items])
    grams = _grams([x[1] for x in items], shingle)
    whole = [np.concatenate(x) for x in zip(asked, told)]
    used = sorted((i for i in range(len(items)) if len(whole[i])), key=lambda i: len(whole[i]))
    if not used:
        return [], 0
    mean = sum(len(whole[i]) for i in used) / len(used)
    terms, df = np.unique(np.concatenate([np.unique(whole[i]) for i in used]), return_counts=True)
    idf = np.log(1 + (len(used) - df + 0.5) / (df + 0.5))
    shards = []
    for at in range(0, len(used), SHARD_ITEMS):
        own = used[at : at + SHARD_ITEMS]
        have = np.unique(np.concatenate([whole[i] for i in own]))
        weight = idf[np.searchsorted(terms, have)]
        share = np.zeros((len(have) + 1, len(own)), dtype=np.float32)
        for k, i in enumerate(own):
            word, tf = np.unique(whole[i], return_counts=True)
            row = np.searchsorted(have, word)
            score = weight[row] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(whole[i]) / mean))
            share[row, k] = score / score.sum()
        cuts = np.arange(0, len(own), BLOCK)
        frequent = np.append(weight < min(FREQUENT_IDF, float(weight.max())), False)
        bound = np.maximum.reduceat(share, cuts, axis=1)
        bound[frequent] = 0
        base = np.maximum.reduceat(share[frequent].sum(0), cuts)
        shards.append(Shard(np.array([items[i][0] for i in own]), have, share, bound, base, [grams[i] for i in own], [np.unique(told[i]) for i in own]))
    return shards, max(map(len, whole))


def _passages(part: Texts, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of steps of ``step`` words, the text of each, and whether the next step is of the same text."""
    counts = part.counts
    n = -(-counts // step)
    own = np.repeat(np.arange(len(part)), n)
    starts = part.bounds[:-1][own] + step * (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n))
    return starts, own, np.append(own[1:] == own[:-1], False)


def _search(part: Texts, shard: Shard, words: np.ndarray, step: int, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, end) of every passage of two steps and every item at or above the threshold."""
    starts, own, joined = _passages(part, step)
    if not len(starts):
        return
    at = np.searchsorted(shard.terms, words)
    at[at == len(shard.terms)] = 0
    term = np.where(shard.terms[at] == words, at, len(shard.terms))
    sums = np.add.reduceat(shard.bound[term], starts, axis=0)
    both = sums.copy()
    both[:-1] += np.where(joined[:-1, None], sums[1:], 0)
    ends = part.bounds[1:][own]
    # a last step is inside the passage before it
    first = np.append(True, own[1:] != own[:-1])
    alone = joined | first
    able = np.argwhere((both + shard.base >= threshold - 1e-5) & alone[:, None])
    for row, blocks in zip(*_grouped(able)):
        b, e = int(starts[row]), int(min(starts[row] + 2 * step, ends[row]))
        held = np.unique(term[b:e])
        for block in blocks:
            scores = shard.share[held, block * BLOCK : (block + 1) * BLOCK].sum(0, dtype=np.float64)
            for k in np.flatnonzero(scores >= threshold - 1e-6):
                yield int(own[row]), int(block * BLOCK + k), float(scores[k]), b, e


def _grouped(pairs: np.ndarray) -> tuple[list[int], list[list[int]]]:
    if not len(pairs):
        return [], []
    rows, cuts = np.unique(pairs[:, 0], return_index=True)
    return rows.tolist(), [x.tolist() for x in np.split(pairs[:, 1], cuts[1:])]


def _overlap(want: np.ndarray, have: np.ndarray) -> float:
    return float(np.isin(want, have).mean()) if len(want) else 1.0


def leaks(
    docs: DataFrame, items: DataFrame, threshold: float = 0.5, question_overlap: float = 0.75, answer_overlap: float = 0.75, shingle: int = 5
) -> DataFrame:
    """Pairs of a document and a test item that it contains: doc_id, item_id, score, question_overlap, answer_overlap, first_word, last_word.

    ``docs`` has doc_id and text, ``items`` item_id, question and answer;
    other columns are left out. Words count without ASCII signs at their ends
    and with A-Z as a-z. Every passage of twice the longest item's words, begun at
    every multiple of that length, is a query, so each item that a text holds lies
    whole in one. ``score`` is the BM25 score of the best passage as a share of the item's
    own score, retrieved from ``threshold`` on. A pair is verified when the passage
    holds ``question_overlap`` of the question's word shingles and ``answer_overlap`` of
    the answer's distinct words; what an item lacks (null or empty) counts as
    held, but an item without words matches nothing. first_word and last_word
    number the passage's words from 0. Null or empty texts match nothing. Repeated rows
    give repeated pairs; a null doc_id or item_id stays null.
    """
    found = None
    for sent in _indexes(docs.sparkSession, items, shingle):
        part = _query(docs, sent, threshold, question_overlap, answer_overlap, shingle)
        found = part if found is None else found.unionByName(part)
    return found


def _indexes(spark: SparkSession, items: DataFrame, shingle: int) -> Iterator[Broadcast]:
    """Indexes of all items, each of a bounded number of them."""
    held = items.select(F.col("item_id").cast("bigint"), F.col("question").cast("string"), F.col("answer").cast("string"))
    size = held.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("question")), F.lit(0)).alias("q"), F.coalesce(F.sum(F.length("answer")), F.lit(0)).alias("a")).first()
    groups = max(1, -(-size.n // GROUP_ITEMS), -(-(size.q + size.a) // GROUP_CHARS))
    for g in range(groups):
        own = held if groups == 1 else held.where(F.pmod(F.xxhash64("item_id", "question", "answer"), F.lit(groups)) == g)
        yield spark.sparkContext.broadcast(index([tuple(r) for r in own.collect()], shingle))


def _hits(batch: pa.RecordBatch, sent: Broadcast, threshold: float, least_question: float, least_answer: float, shingle: int) -> list[tuple]:
    """(row of the batch, item, score, overlaps, place) of every item that a row holds."""
    shards, step = sent.value
    rows = []
    for whole in texts(batch.column("text"), lower=True) if shards else ():
        part = _trimmed(whole)
        words = word_hashes(part)
        grams = None
        for shard in shards:
            best: dict[tuple[int, int], tuple] = {}
            for i, k, score, b, e in _search(part, shard, words, step, threshold):
                grams = gram_hashes(words, shingle) if grams is None else grams
                if len(shard.question[k]) == 1:
                    asked = float(_holds(shard.question[k], words[b:e], shingle))
                else:
                    asked = _overlap(shard.question[k], grams[b : max(b, e - shingle + 1)])
                told = _overlap(shard.answer[k], words[b:e])
                if asked >= least_question and told >= least_answer and score > best.get((i, k), (0.0,))[0]:
                    best[i, k] = (score, asked, told, b - int(part.bounds[i]), e - 1 - int(part.bounds[i]))
            rows += [(whole.first + i, shard.items[k], *x) for (i, k), x in best.items()]
    return rows


def _query(docs: DataFrame, sent: Broadcast, threshold: float, least_question: float, least_answer: float, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _hits(batch, sent, threshold, least_question, least_answer, shingle)
            if rows:
                which, *rest = map(list, zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()).take(pa.array(which)), pa.array([None if x is None else int(x) for x in rest[0]], pa.int64()), *(pa.array(x, pa.float64()) for x in rest[1:4]), *(pa.array(x, pa.int64()) for x in rest[4:])],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word", "last_word"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, _HIT)


def _holds(want: np.ndarray, words: np.ndarray, shingle: int) -> bool:
    """Whether a question of one shingle is in the passage; it may be shorter than a shingle."""
    return any(np.isin(want, gram_hashes(words, n) if n == shingle else mix(gram_hashes(words, n) + np.uint64(n))).all() for n in range(1, shingle + 1))


def halves(items: DataFrame, share: float = 0.75) -> DataFrame:
    """Items given as one text: the first ``share`` of the words is the question, the rest the answer."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.ceil(F.size("words") * F.lit(share)).cast("int")
    return items.withColumn("words", words).select(
        "item_id", F.array_join(F.slice("words", F.lit(1), cut), " ").alias("question"),
        F.array_join(F.slice("words", cut + 1, F.size("words")), " ").alias("answer"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.5, question_overlap: float = 0.75, answer_overlap: float = 0.75, shingle: int = 5) -> DataFrame:
    """``docs``, all columns, without the rows that hold a test item.

    Each row is judged by its own text where it is read, so nothing is shuffled,
    and rows that repeat a doc_id or have none are judged like any other.
    """
    for sent in _indexes(docs.sparkSession, items, shingle):

        def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[x[0] for x in _hits(batch, sent, threshold, question_overlap, answer_overlap, shingle)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
