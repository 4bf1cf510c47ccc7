"""The other text operators beside brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.plain import corpus, frame, low, words
from tidemill.llm import bins, decontamination, license_scan, matrices, packing, quality_rules, tokens, toxicity

EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def order(rows):
    return sorted(rows, key=str)


def trimmed(text):
    found = (re.sub(rb"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", b"", w) for w in low(text).split())
    return b" " + b" ".join(w for w in found if w) + b" "


# ---- benchmark leaks ---------------------------------------------------------


@pytest.fixture(scope="module")
def leaky(spark):
    rng = random.Random(5)
    pool = [f"v{k}" for k in range(300)] + ["the", "of", "and"] * 30
    items = [(k, " ".join(rng.choices(pool, k=rng.randint(15, 40)))) for k in range(40)] + [(90, None), (91, ""), (92, "!!! ...")]
    docs = [(k, " ".join(rng.choices(pool, k=rng.randint(3, 400)))) for k in range(60)]
    for k in range(30):
        body = rng.choices(pool, k=rng.randint(0, 300))
        at = rng.randint(0, len(body))
        item = items[k % 40][1]
        docs.append((100 + k, " ".join([*body[:at], item.upper() if k % 2 else item + ".", *body[at:]])))
    return items, [*docs, (200, None), (201, ""), (None, items[3][1]), docs[-1]]


def test_leaks_equal_search(spark, leaky, monkeypatch):
    items, docs = leaky
    want = order((d, i) for d, t in docs for i, x in items if trimmed(x).strip() and trimmed(x) in trimmed(t))
    given = decontamination.halves(spark.createDataFrame(items, "item_id long, text string"))
    for shard in (256, 7):
        monkeypatch.setattr(decontamination, "SHARD_ITEMS", shard)
        got = decontamination.leaks(frame(spark, docs), given)
        assert order((r.doc_id, r.item_id) for r in got.collect()) == want
    monkeypatch.setattr(decontamination, "GROUP_ITEMS", 9)
    assert order((r.doc_id, r.item_id) for r in decontamination.leaks(frame(spark, docs), given).collect()) == want


def test_blocks_lose_no_item_above_the_threshold(leaky):
    items, docs = leaky
    shards, step = decontamination.index([(i, x, None) for i, x in items])
    threshold = 0.2
    for part in decontamination.texts(pa.array([t for _, t in docs]), lower=True):
        part = decontamination._trimmed(part)
        hashes = decontamination.word_hashes(part)
        for shard in shards:
            got = {(i, k, b): s for i, k, s, b, _ in decontamination._search(part, shard, hashes, step, threshold)}
            want = {}
            for i in range(len(part)):
                begin, end = int(part.bounds[i]), int(part.bounds[i + 1])
                for b in range(begin, end, step):
                    if b > begin and b + step >= end:
                        continue
                    held = np.isin(shard.terms, hashes[b : min(b + 2 * step, end)])
                    for k, s in enumerate(shard.share[:-1][held].sum(0, dtype=np.float64)):
                        if s >= threshold:
                            want[i, k, b] = s
            assert set(want) <= set(got) and all(got[x] == pytest.approx(s, abs=1e-5) for x, s in want.items())


def test_leaks_of_nothing_and_short_questions(spark):
    docs = frame(spark, [(1, "what is up my friend"), (2, "up my"), (3, None)])
    none = spark.createDataFrame([], "item_id long, question string, answer string")
    assert decontamination.leaks(docs, none).count() == 0
    items = spark.createDataFrame([(1, "is up", "friend"), (2, "my up", None), (None, None, "up my")], "item_id long, question string, answer string")
    got = order((r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect())
    assert got == order([(1, 1), (1, None), (2, None)])
    assert decontamination.leaks(spark.createDataFrame([], EMPTY), items).count() == 0
    kept = decontamination.decontaminate(docs, items)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [3]


def test_rows_with_a_leak_go_by_themselves(spark):
    rng = random.Random(3)
    item = " ".join(f"q{k}" for k in range(20))
    clean = [" ".join(rng.choices([f"w{k}" for k in range(50)], k=30)) for _ in range(3)]
    docs = frame(spark, [(1, clean[0]), (1, f"{clean[1]} {item}"), (None, f"{item} {clean[2]}"), (None, clean[2]), (2, None)])
    items = decontamination.halves(spark.createDataFrame([(5, item)], "item_id long, text string"))
    kept = decontamination.decontaminate(docs, items)
    assert kept.schema == docs.schema and order((r.doc_id, r.text) for r in kept.collect()) == order([(1, clean[0]), (None, clean[2]), (2, None)])
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()


# ---- licenses ----------------------------------------------------------------


def notices_by_name(notices):
    return {name: [x for n, x in notices if n == name] for name, _ in notices}


def test_notices_equal_search(spark):
    rng = random.Random(9)
    notices = [(name, x) for name, xs in license_scan.NOTICES.items() for x in xs]
    docs = [(1000, None), (1001, ""), (1002, "MIT"), (None, notices[0][1])]
    for k in range(80):
        body = rng.choices(["the", "license", "under", "version", "licensed", "a", "rights", "of", "mit"], k=rng.randint(0, 90))
        for name, x in rng.sample(notices, k=rng.randint(0, 2)):
            at = rng.randint(0, len(body))
            body[at:at] = (x.upper() if k % 3 == 0 else x).split()
        docs.append((k, " ".join(body)))
    docs.append(docs[-1])
    got = license_scan.scan(frame(spark, docs))
    sure = {(d, name) for d, t in docs for name, x in notices if trimmed(x) in trimmed(t)}
    assert sure <= {(r.doc_id, r.license) for r in got.collect()}
    exact = license_scan.scan(frame(spark, docs), contained=1.0)

    def grams(text):
        w = trimmed(text).split()
        return set(zip(w, w[1:], w[2:]))

    templates = {name: [grams(x) for x in xs] for name, xs in notices_by_name(notices).items()}
    held = {d: grams(t) for d, t in docs}
    assert all(any(x <= held[r.doc_id] for x in templates[r.license]) for r in exact.collect())
    assert license_scan.scan(spark.createDataFrame([], EMPTY)).count() == 0


def test_whole_license_texts_are_found(spark):
    rng = random.Random(5)
    whole = {name: max(xs, key=len) for name, xs in license_scan.NOTICES.items() if max(map(len, xs)) > 400}
    assert {"MIT", "ISC", "Unlicense", "CC0-1.0", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause"} <= set(whole)
    docs, names = [], []
    for name, text in sorted(whole.items()):
        edited = ["changed" if rng.random() < 0.02 else w for w in text.split()]
        for body in (text.split(), edited):
            docs.append((len(docs), " ".join([*(f"a{k}" for k in range(rng.randint(0, 300))), *body, *(f"b{k}" for k in range(rng.randint(0, 300)))])))
            names.append(name)
    header = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    for name, *x in (("GPL-2.0", "program", "", "2"), ("LGPL-3.0", "library", "Lesser ", "3"), ("AGPL-3.0", "program", "Affero ", "3")):
        docs.append((len(docs), header.format(*x)))
        names.append(name)
    docs.append((len(docs), whole["MIT"].split("\n\n")[0]))
    names.append("MIT")
    best = {}
    for r in license_scan.scan(frame(spark, docs)).collect():
        best.setdefault(r.doc_id, {})[r.license] = r.containment
    assert [n for k, n in enumerate(names) if n not in best.get(k, {})] == []
    assert all(best[k][n] == max(best[k].values()) for k, n in enumerate(names) if best[k][n] == 1)
    assert all(best[k][n] == 1 for k, n in enumerate(names) if k >= 2 * len(whole))


def test_bands_promise():
    assert license_scan.guarantee(0.4) > 0.99999
    with pytest.raises(ValueError, match="too seldom"):
        license_scan._classes(license_scan.NOTICES, rows=4, bands=2, shingle=3)


# ---- tokens and packing --------------------------------------------------------

ODD = ["don't x'S 'll", "a..b c., d", "É é é", "ΑΣ Σ", "a_b _. x", "1.5,2", "\x1ca b\x85c", "<|endoftext|> x", "ﬁ Ǆ İ", "日本語。テスト", "​ x",
       None, "", "é x́. áb", "½²", "naïve—x", "H̱ ẖ", "a̸= ≠", " x　y", "ÀÉ×÷ß"]


def test_ids_equal_the_tokenizer():
    path = tokens.vocabulary()
    whole = tokens.encoder(path).whole
    texts = [t for _, t in corpus(40)] + ODD
    got = [ids[a:b].tolist() for ids, at in tokens.encoded(pa.array(texts), path) for a, b in zip(at[:-1], at[1:])]
    assert got == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    path = tokens.vocabulary("byte_bpe_50k.json")  # of another kind
    got = [ids[a:b].tolist() for ids, at in tokens.encoded(pa.array(ODD), path) for a, b in zip(at[:-1], at[1:])]
    assert got == [tokens.encoder(path).whole.encode(t or "", add_special_tokens=False).ids for t in ODD]


def test_added_tokens_keep_their_ids():
    from tokenizers import Tokenizer

    held = ["<|endoftext|> x", "a<|endoftext|>b, c", "", None, "x <|startoftext|><|endoftext|> É", "<|endofte", "xt|> y", "<|ENDOFTEXT|>", "<|endoftext|>", "end"]
    texts = [*held, *ODD, *[t for _, t in corpus(10)], *held]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = tokens.vocabulary(name)
        own = Tokenizer.from_file(path)  # nothing else set
        want = [own.encode(t or "", add_special_tokens=False).ids for t in texts]
        got = [ids[a:b].tolist() for ids, at in tokens.encoded(pa.array(texts), path) for a, b in zip(at[:-1], at[1:])]
        assert got == want and any(max(ids, default=0) in (49407, 50256) for ids in want)


def full_ids(rows):
    whole = tokens.encoder(tokens.vocabulary()).whole
    return [(d, [*whole.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows]


def test_packing_is_lossless_and_tight(spark):
    rows = [*corpus(60), (7, "again"), (7, None)]
    got = packing.pack(frame(spark, rows), capacity=256, task_pieces=20).toPandas()
    want = [(d, n, at, len(ids[at : at + 256]), zlib.crc32(np.array(ids[at : at + 256], "<u4"))) for d, ids in full_ids(rows) for n, at in enumerate(range(0, len(ids), 256))]
    assert order(tuple(None if x != x else int(x) for x in r) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) == order(want)
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() <= 256
    short = got.length[got.length < 256].to_numpy()
    assert got.sequence_id.nunique() <= (got.length == 256).sum() + len(bins.best_fit_decreasing(short, 256)) + 1
    assert packing.pack(spark.createDataFrame([], EMPTY)).count() == 0


def test_local_search_empties_bins():
    # best fit decreasing needs three bins here, two are enough
    lengths = np.array([6, 5, 5, 4, 4, 3, 3], dtype=np.int64)
    for seed in range(20):
        lengths = np.random.default_rng(seed).integers(5, 60, 60)
        first = bins.best_fit_decreasing(lengths, 100)
        better = bins.improve(lengths, first, 100)
        assert sorted(sum(better, [])) == list(range(60)) and max(lengths[b].sum() for b in better) <= 100 and len(better) <= len(first)
    lengths = np.repeat([30, 70, 55, 45], 5)
    assert len(bins.improve(lengths, [[k] for k in range(20)], 100)) == 10


def test_tightest_bin_is_found():
    room, rng, held = bins.Room(100), random.Random(2), []
    for k in range(2000):
        if held and rng.random() < 0.5:
            need = rng.randint(1, 100)
            got = room.take(need)
            fit = [r for r, _ in held if r >= need]
            assert (got is None) == (not fit) and (not fit or got[1] == min(fit))
            if got:
                held.remove((got[1], got[0]))
        else:
            held.append((rng.randint(1, 100), k))
            room.add(*held[-1])


def test_matrix_rows_leave_a_buffer_that_nothing_fills(monkeypatch):
    """Pieces of more than half a row never fit together; the buffer must not grow with the split."""
    import pyspark

    held = []
    pack = bins.best_fit_decreasing
    monkeypatch.setattr(matrices.bins, "best_fit_decreasing", lambda lengths, capacity: held.append(int(lengths.sum())) or pack(lengths, capacity))
    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})()))
    monkeypatch.setattr(matrices, "encoded", lambda column, path: iter([(np.arange(600_000, dtype="<u4") % 97, np.arange(0, 600_001, 60))]))

    class Docs:
        def select(self, *names):
            return self

        def mapInArrow(self, run, kinds):
            batch = pa.RecordBatch.from_pydict({"doc_id": list(range(10_000)), "text": [""] * 10_000})
            return [r for b in run(iter([batch])) for r in b.to_pylist()]

    rows = matrices.packed_rows(Docs(), "x", capacity=100, buffer_ids=5_000)
    assert max(held) <= 5_000 + 61 and len(held) < 10_000 // 20
    assert sorted(d for r in rows for d in r["doc_ids"]) == list(range(10_000))


def test_matrices_give_the_documents_back(spark):
    rows = corpus(60)
    back = Counter()
    for r in matrices.packed_rows(frame(spark, rows), capacity=256, buffer_ids=3000).collect():
        ids, places = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        assert len(ids) == len(places) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and not ids[r.n_tokens :].any()
        for d, n, b, e in zip(r.doc_ids, r.pieces, r.cu_seqlens[:-1], r.cu_seqlens[1:]):
            back[d, n, tuple(ids[b:e].tolist())] += 1
            assert places[b:e].tolist() == list(range(e - b))
    want = Counter((d, n, tuple(ids[at : at + 256])) for d, ids in full_ids(rows) for n, at in enumerate(range(0, len(ids), 256)))
    assert back == want
    assert matrices.packed_rows(spark.createDataFrame([], EMPTY)).count() == 0


# ---- quality -------------------------------------------------------------------


def plain_counts(text):
    w = (text or "").encode().split()
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def test_counts_and_base_rule(spark):
    rows = [*corpus(60), (1, "a b c d e a b c d e a"), (2, "x\n\nx\n \nx y\nx"), (3, "# | <é> " * 30), (4, "é é   z")]
    got = quality_rules.judge(frame(spark, rows), least_rows=5).collect()
    want = []
    for d, t in rows:
        n, *rest = plain_counts(t)
        want.append((d, n, *rest, n < 10 or 100 * rest[-1] > 20 * n))
    assert order((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == order(want)
    assert all(not r.kept for r in got if r.base_failed) and all(r.distance is not None for r in got if not r.base_failed)


def plain_distances(x):
    """The estimate for one group in numpy."""
    floors = np.array(quality_rules.FLOORS)
    grid = lambda v: np.floor(np.abs(v) * 64 + 0.5) * np.sign(v) / 64
    far = lambda d: grid(np.log1p(d) * 4)
    q = np.quantile(grid(x), [0.25, 0.5, 0.75], axis=0)
    d = (((x - q[1]) / np.maximum((q[2] - q[0]) / 1.349, floors)) ** 2).sum(1)
    for _ in range(quality_rules.STEPS):
        own = x[far(d) <= np.quantile(far(d), quality_rules.SHARE)]
        cov = np.cov(own.T, bias=True) + np.diag(floors**2)
        z = np.linalg.solve(np.linalg.cholesky(cov), (x - own.mean(0)).T)
        d = (z**2).sum(0)
    return d / max(np.expm1(np.quantile(far(d), 0.5) / 4) / quality_rules.MEDIAN_5, 1)


def test_distances_equal_numpy(spark):
    rng = np.random.default_rng(4)
    data = {g: rng.normal(size=(n, 5)) * [1, 0.3, 0.2, 0.1, 0.5] + k for k, (g, n) in enumerate({"a": 400, "b": 57}.items())}
    data["a"][:40] += 9
    rows = [(g, i, *map(float, v)) for g, x in data.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "group string, i int, " + ", ".join(f"{s} double" for s in quality_rules.STATS))
    got = quality_rules.mcd_distances(df).toPandas().sort_values(["group", "i"])
    for g, x in data.items():
        assert got[got.group == g].d.to_numpy() == pytest.approx(plain_distances(x), rel=1e-6)
    assert (got[(got.group == "a") & (got.i < 40)].d > 30).all()


def test_rejected_rows_go(spark):
    good = [(k, " ".join(f"w{((k + 1) * j) % 97}" for j in range(40 + k))) for k in range(40)]
    junk = [(100, " ".join(["ab###$$$%%%|||"] * 1 + [f"x{k}###$$$|||" for k in range(60)])), (101, None), (102, "short")]
    df = frame(spark, [*good, *junk, (None, good[3][1]), good[5]], more=False)
    kept = quality_rules.keep_good(df, least_rows=10)
    assert kept.columns == df.columns
    assert order(r.doc_id for r in kept.collect()) == order([*[d for d, _ in good], None, 5])
    assert quality_rules.keep_good(spark.createDataFrame([], EMPTY)).count() == 0
    plan = quality_rules.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_each_statistic_rejects_alone(spark):
    good = [(k, " ".join(f"w{((k + 1) * j) % 97}" for j in range(40 + k))) for k in range(50)]
    odd = {
        "symbols": " ".join(f"w{j}" + "#" * (j % 3 == 0) for j in range(60)),
        "length": " ".join(f"averylongword{j}" for j in range(60)),
        "lines": "\n".join(random.Random(3).choices([f"x{j}" for j in range(12)], k=80)),
        "repeats": " ".join(f"w{j}" for j in [*range(6), *range(54)]),
        "size": " ".join(f"w{j * 7}" for j in range(40_000)),
    }
    long = "\n".join([" ".join(f"w{x}" for x in random.Random(k).choices(range(97), k=5)) for k in range(400)] + ["x y", "z a"] * 2)
    rows = [*good, *((100 + k, t) for k, t in enumerate(odd.values())), (200, long)]
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, rows, more=False), least_rows=10).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {name: got[100 + k].kept for k, name in enumerate(odd)} == dict.fromkeys(odd, False)
    assert all(got[k].kept for k in range(50)) and got[200].kept


# ---- toxicity ------------------------------------------------------------------


def test_toxic_texts_are_found_in_the_held_out_fold(spark):
    rng = random.Random(6)
    clean = [f"w{k}" for k in range(500)]
    rows, labels = [], []
    for k in range(900):
        body, toxic = rng.choices(clean, k=rng.randint(5, 80)), k % 6 == 0
        if toxic:
            for x in rng.sample(["grotty", "vilely", "nastiest", "scabby"], k=2):
                body.insert(rng.randint(0, len(body)), x.upper() if k % 4 else x + "!")
        rows.append((k, " ".join(body)))
        labels.append((k, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "scabby grotty"), rows[6]]
    known = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    got = toxicity.score(frame(spark, rows), known).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert len(held) > 150 and sum(r.predicted != truth[r.doc_id] for r in held) <= 0.02 * len(held)
    assert all(r.predicted == 0 for r in got if r.doc_id in (1000, 1001)) and all(r.predicted == 1 for r in got if r.doc_id is None)


def test_held_out_labels_change_nothing(spark):
    rows = [(k, "bad thing here" if k % 3 == 0 else f"fine thing {k}") for k in range(200)]
    fold = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    one = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(200)], "doc_id long, toxic int")
    two = one.withColumn("toxic", F.when(F.col("doc_id").isin([k for k in range(200) if fold(k)]), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (order(tuple(r) for r in toxicity.score(frame(spark, rows), x).collect()) for x in (one, two))
    assert a == b


def test_no_labels(spark):
    got = toxicity.score(frame(spark, corpus(6)), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert all(r.score == 0 and r.predicted == 0 for r in got)
    assert toxicity.score(spark.createDataFrame([], EMPTY), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0
