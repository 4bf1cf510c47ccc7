"""Near duplicates and repeated passages beside brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tests.llm.plain import corpus, frame, low, words
from tidemill.llm import components, ngram_join, signature_tree, substring_dedup

EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = low(text).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_classes(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(s), None if doc is None else least[find(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets))]


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("block_bytes", [8 << 20, 3000])
def test_classes_equal_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", block_bytes)
    rows = corpus()
    got = ngram_join.near_duplicates(frame(spark, rows)).collect()
    assert order(tuple(r) for r in got) == order(plain_classes(rows))


def test_one_of_each_class_stays(spark):
    rows = corpus(24)
    got = ngram_join.keep_first(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    want = [doc for doc, _, least in plain_classes(rows) if doc is not None and doc == least]
    assert order(r.doc_id for r in got.collect()) == order(want)  # the row without doc_id is a copy of a named one
    again = ngram_join.keep_first(frame(spark, [*rows, rows[5], rows[5]]))
    assert order(r.doc_id for r in again.collect()) == order(want)


def chain():
    """Three texts of which the middle one is linked with both others, which are not linked."""
    rng = random.Random(6)
    base = [f"c{k}" for k in rng.sample(range(10_000), 200)]
    a, b = list(base), list(base)
    for k in range(3):
        a[20 + 25 * k], b[120 + 25 * k] = f"a{k}", f"b{k}"
    texts = [" ".join(x) for x in (a, base, b)]
    sets = [shingles(t) for t in texts]
    near = lambda i, j: 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    for k in range(3, 40):
        if near(0, 1) and near(1, 2) and not near(0, 2):
            break
        if near(0, 2):
            a[3 * k], b[3 * k + 1] = f"a{k}", f"b{k}"
            texts = [" ".join(x) for x in (a, base, b)]
            sets = [shingles(t) for t in texts]
    assert near(0, 1) and near(1, 2) and not near(0, 2)
    return texts


def test_rows_without_doc_id_link_others(spark):
    a, middle, b = chain()
    for rows in ([(1, a), (2, middle), (3, b)], [(1, a), (None, middle), (3, b)], [(1, a), (None, middle), (None, middle), (3, b)]):
        got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(frame(spark, rows)).collect()}
        assert got[1] == got[3] == 1
        assert [r.doc_id for r in ngram_join.keep_first(frame(spark, rows)).collect()] == [1]
    apart = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(frame(spark, [(1, a), (3, b)])).collect()}
    assert apart == {1: 1, 3: 3}


def test_rows_are_kept_by_their_own_texts(spark):
    rng = random.Random(9)
    one, other, third = (" ".join(rng.choices([f"{c}{k}" for k in range(99)], k=60)) for c in "xyz")
    rows = [(7, one), (7, other), (7, one), (8, other), (8, third), (None, third), (None, one), (9, None), (9, ""), (None, None), (None, " ")]
    rows += [(None, "alone a b c d e f"), (None, "alone a b c d e f")]
    got = ngram_join.keep_first(frame(spark, rows)).collect()
    assert order((r.doc_id, (r.text or "").strip()) for r in got) == order([(7, one), (7, other), (8, third), (9, ""), (None, ""), (None, ""), (None, "alone a b c d e f")])


def test_near_duplicates_of_nothing(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0
    rows = [(1, None), (2, ""), (3, "\n")]
    assert order(tuple(r) for r in ngram_join.near_duplicates(frame(spark, rows)).collect()) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


@pytest.mark.parametrize("size", [2, 7, 150, 600])
def test_signature_tree_loses_no_link(size):
    rng = np.random.default_rng(size)
    base = rng.integers(0, 2**63, 120).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(120) < 0.9], rng.integers(0, 2**63, rng.integers(1, 20)).astype(np.uint64)])) for _ in range(size)]
    comps = rng.integers(0, size, size)

    def classes(pairs):
        up = {c: c for c in comps.tolist()}

        def find(c):
            while up[c] != c:
                c = up[c]
            return c

        for i, j in pairs:
            a, b = find(int(comps[i])), find(int(comps[j]))
            up[max(a, b)] = min(a, b)
        return {c: find(c) for c in up}

    every = [(i, j) for i in range(size) for j in range(i) if signature_tree.linked(sets[i], sets[j], 75)]
    found = signature_tree.links(sets, comps, 75)
    assert len(found) < size and classes(found) == classes(every)


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 140)] + [(5, k) for k in range(6, 40)] + [(-3, 500)] + [(k, k) for k in (900,)]
    rng.shuffle(edges)
    edges = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges]
    df = spark.createDataFrame(edges, "a long, b long")
    labels = components.merge(components.merge(None, df.where("a % 2 = 0")), df.where("a % 2 <> 0"))
    got = {r.node: r.comp for r in labels.collect()}
    want = {k: 100 for k in range(100, 141)} | {k: 5 for k in range(5, 40)} | {-3: -3, 500: -3, 900: 900}
    assert got == want


def plain_removal(rows, window=13):
    first = {}
    for doc, text in rows:
        w = words(text)
        for s in range(len(w) - window + 1):
            if doc is not None:
                key = tuple(w[s : s + window])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = set()
        for s in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[s : s + window])] < doc:
                gone |= set(range(s, s + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark):
    rows = corpus()
    rows += [rows[8], (rows[9][0], rows[10][1])]  # a repeated row, and one doc_id with two texts
    got = substring_dedup.digest(substring_dedup.remove_repeats(frame(spark, rows))).collect()
    assert order(tuple(r) for r in got) == order(plain_removal(rows))


def test_spans_and_small_pieces(spark, monkeypatch):
    from tidemill.llm import repeats

    monkeypatch.setattr(repeats, "FLUSH", 50)
    rows = corpus(30)
    for r in substring_dedup.remove_repeats(frame(spark, rows)).collect():
        assert sum(e - b for b, e in r.spans) == r.n_removed and len(r.kept.split()) <= r.n_words - r.n_removed
    assert order(tuple(r) for r in substring_dedup.digest(substring_dedup.remove_repeats(frame(spark, rows))).collect()) == order(plain_removal(rows))


def test_text_without_repeats_keeps_columns_and_white_space(spark):
    rows = corpus(30)
    got = substring_dedup.without_repeats(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    want = {doc: (n, gone, digest) for doc, n, gone, digest in plain_removal(rows)}
    before = dict(rows)
    for r in got.collect():
        n, gone, digest = want[r.doc_id]
        assert hashlib.sha256(b" ".join(words(r.text))).hexdigest() == digest
        if not gone:
            assert r.text == before[r.doc_id]
    assert substring_dedup.without_repeats(spark.createDataFrame([], EMPTY)).count() == 0
    assert substring_dedup.remove_repeats(spark.createDataFrame([], EMPTY)).count() == 0
