"""Context-tree weighting beside a plain recursion, and the query beside plain counting."""

from __future__ import annotations

import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemill.llm import lm_scoring

ROWS = [
    (i, t)
    for i, t in enumerate(["abracadabra", "ABRA cad abra", "", None, "the then\tthe", "cabra é x", "a" * 40, "abra cadabra abra", "zz top", "the the the"] * 3)
]


def _held(doc) -> bool:
    return zlib.crc32(str(doc).encode()) % 7 == 2


def _low(text) -> bytes:
    return (text or "").encode().lower()


def _kt(zeros: int, ones: int) -> float:
    return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)


def plain_scores(rows, depth: int) -> list[float]:
    counts = defaultdict(lambda: [0, 0])  # (context, bits so far) -> zeros, ones
    children = defaultdict(set)

    def steps(text):
        data = b"\0" * depth + text + b"\0"
        for p in range(depth, len(data)):
            for k in range(8):
                yield data[p - depth : p], format(data[p], "08b")[:k], int(format(data[p], "08b")[k])

    for doc, text in rows:
        if not _held(doc):
            for context, bits, bit in steps(_low(text)):
                for d in range(depth + 1):
                    counts[context[depth - d :], bits][bit] += 1
                    if d:
                        children[context[depth - d + 1 :], bits].add(context[depth - d :])

    memo = {}

    def weighted(context, bits):
        key = context, bits
        if key not in memo:
            own = _kt(*counts[key])
            if len(context) == depth:
                memo[key] = own
            else:
                memo[key] = np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(weighted(c, bits) for c in children[key]))
        return memo[key]

    def chance(context, bits, bit, d):
        key = context[depth - d :], bits
        zeros, ones = counts.get(key, (0, 0))
        here = ((ones if bit else zeros) + 0.5) / (zeros + ones + 1)
        if d == depth or (context[depth - d - 1 :], bits) not in counts:
            return here
        stop = math.exp(math.log(0.5) + _kt(zeros, ones) - weighted(*key))
        return stop * here + (1 - stop) * chance(context, bits, bit, d + 1)

    return [sum(math.log10(chance(c, b, x, 0)) for c, b, x in steps(_low(text))) for _, text in rows]


@pytest.mark.parametrize("share", [5_000_000, 7])
def test_scores_equal_plain_recursion(spark, share):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in ROWS], "doc_id long, text string, row int, base string")
    got = {r.doc_id: r for r in lm_scoring.score(docs, depth=2, share_grams=share).collect()}
    words = Counter(w for i, t in ROWS if not _held(i) for w in [*_low(t).split(), None])
    n, v = sum(words.values()), len(words)
    for (i, text), score in zip(ROWS, plain_scores(ROWS, 2)):
        own = [*_low(text).split(), None]
        row = got[i]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (_held(i), len(own), sum(w in words for w in own), n)
        assert row.base_score == pytest.approx(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in own), rel=1e-9, abs=1e-9)
        assert row.score == pytest.approx(score, rel=1e-5)


def test_probabilities_of_a_byte_sum_to_one(spark):
    from tidemill.llm import context_tree

    rng = np.random.default_rng(0)
    grams = np.array([(c << 16) | (d << 8) | x for c in (97, 98) for d in (0, 97) for x in range(256)], dtype=np.uint64)
    counts = rng.poisson(0.05, len(grams)) * rng.integers(1, 100_000, len(grams))
    chances, nodes = context_tree.subtree(grams, counts, 2)
    total = np.exp(context_tree.code(grams, chances, *context_tree.root(*nodes))).reshape(-1, 256).sum(1)
    assert total == pytest.approx(np.ones(4), rel=1e-9)


def test_no_documents_and_no_training(spark):
    assert lm_scoring.score(spark.createDataFrame([], "doc_id long, text string"), depth=2).count() == 0
    only = [i for i in range(100) if _held(i)][:2]
    rows = lm_scoring.score(spark.createDataFrame([(i, "ab") for i in only], "doc_id long, text string"), depth=2).collect()
    assert [r.score for r in rows] == pytest.approx([-24 * math.log10(2)] * 2) and all(r.base_score == 0 and r.n_known == 0 for r in rows)


def test_tasks_hold_little_beside_the_tables():
    """Counting and scoring 12 MB of text in one batch: arrays follow a slice and the distinct keys, whatever the batch."""
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(2, 9, 3000)]
    rows = [" ".join(words[k] for k in rng.integers(0, len(words), 700)) for _ in range(3000)]
    batch = pa.RecordBatch.from_pydict({"row": list(range(3000)), "doc_id": list(range(3000)), "held_out": [i % 7 == 2 for i in range(3000)], "text": rows})

    class Sent:
        value = (lm_scoring.Table(10, "f4"), lm_scoring.Table(10, "u4"))

    def peak(run) -> float:
        tracemalloc.start()
        n = sum(b.num_rows for b in run)
        most = tracemalloc.get_traced_memory()[1] / 2**20
        tracemalloc.stop()
        assert n > 0
        return most

    assert peak(lm_scoring._counted(iter([batch]), 5)) < 200
    assert peak(lm_scoring._score(5, Sent)(iter([batch]))) < 100


def test_counts_joined_early_and_late_are_the_same(monkeypatch):
    """Counts add up however often a task joins or sends them, also when no row is for training."""
    rows = [t or "" for _, t in ROWS] * 5

    def counted(held) -> Counter:
        batch = pa.RecordBatch.from_pydict({"held_out": held, "text": rows})
        total = Counter()
        for b in lm_scoring._counted(iter([batch, batch]), 3):
            for r in b.to_pylist():
                total[r["word"], r["key"]] += r["n"]
        return total

    cases = [[i % 3 == 0 for i in range(len(rows))], [True] * len(rows)]
    late = [counted(held) for held in cases]
    assert sum(n for (word, _), n in late[0].items() if not word) == 2 * sum(len(_low(t)) + 1 for i, t in enumerate(rows) if i % 3)
    monkeypatch.setattr(lm_scoring, "FLUSH", 5)
    assert [counted(held) for held in cases] == late


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "ab ab"), (1, "ab"), (1, "ab"), (None, None)], "doc_id long, text string")
    rows = lm_scoring.score(docs, depth=2).collect()
    assert len(rows) == 4 and sorted(r.n_tokens for r in rows) == [1, 2, 2, 3]
