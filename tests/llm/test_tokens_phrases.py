"""Alignment of vocabularies, phrases and vector packing beside brute force and round trips."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.plain import corpus, frame, low
from tidemill.llm import alignment, byte_tokens, phrases, tokens, vector_packing
from tidemill.llm.vector_packing import Limits

EMPTY = "doc_id long, text string, lang string, source string, n_chars long"
BYTE, PIECE = tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("piece_bpe_32k.model")
ODD = ["a ▁ b", " ", "   ", "a  ", "<s> <|endoftext|> </s>", "  x\n\n  y  ", "==== " * 50, "漢字“”▁", "漢字“” x \U0001f600\U0001f600ﬁ", "　 a  b \u0085 c", "l" * 3000 + " é", "\x00 \x1c x"]


def order(rows):
    return sorted(rows, key=str)


def plain_alphabet():
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {chr(b if b in own else next(rest)): b for b in range(256)}


@pytest.fixture(scope="module")
def plain_tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    plain, whole = Tokenizer.from_file(BYTE), Tokenizer.from_file(BYTE)
    plain.encode_special_tokens = True
    return plain, whole, sentencepiece.SentencePieceProcessor(model_file=PIECE)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab c \n\t.,'1é漢“▁　\u0085", "the", " x", "<|endoftext|>"]), max_size=30).map("".join) | st.text(max_size=20) | st.none(), max_size=12), st.integers(1, 60))
def test_ids_of_segments_equal_those_of_whole_texts(plain_tokenizers, texts, size):
    plain, whole, piece = plain_tokenizers
    texts = [None if t is None else "".join(c for c in t if not 0xD800 <= ord(c) <= 0xDFFF) for t in texts]
    got = [ids[b:e].tolist() for ids, offsets in byte_tokens.byte_ids(pa.array(texts, pa.string()), BYTE, size) for b, e in zip(offsets[:-1], offsets[1:])]
    assert got == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    a, b = byte_tokens.byte_level(BYTE), byte_tokens.piece_level(PIECE)
    own = iter(texts)
    for part in byte_tokens.segments(pa.array(texts, pa.string()), b" ", size):
        at, which = part.distinct()
        ids, (pieces, same) = a.distinct(part, at), b.distinct(part, at)
        for k in range(len(part)):
            text, mine = next(own), which[part.bounds[k] : part.bounds[k + 1]]
            assert [x for s in mine for x in ids.ids[ids.begin[s] : ids.begin[s + 1]]] == (plain.encode(" " + text, add_special_tokens=False).ids if text else [])
            want = piece.encode(text or "")
            back = b.entries.joined(np.array(want, dtype=np.int64)).tobytes()
            assert bool(same[mine].all()) == (not text or back == (" " + text).encode())
            if text and same[mine].all():
                assert [x for s in mine for x in pieces.ids[pieces.begin[s] : pieces.begin[s + 1]]] == want


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="not a byte-level"):
        byte_tokens.ByteLevel(tokens.vocabulary("word_bpe_49k.json"))


# ---- alignment ----------------------------------------------------------------


def plain_links(rows, byte, piece):
    """Per row doc_id, tokens of A and B, and the groups as (A ids, B ids)."""
    signs = plain_alphabet()
    for doc, text in rows:
        a, b = (byte.encode(" " + text, add_special_tokens=False).ids, piece.encode(text)) if text else ([], [])
        in_a = [bytes(signs[c] for c in byte.id_to_token(i)) for i in a]
        in_b = [bytes([int(piece.id_to_piece(i)[3:5], 16)]) if piece.is_byte(i) else piece.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if text and not b"".join(in_a) == b"".join(in_b) == (" " + text).encode():
            a = b = in_a = in_b = []
        ends_a, ends_b = np.cumsum([len(x) for x in in_a]).tolist(), np.cumsum([len(x) for x in in_b]).tolist()
        groups, low = [], 0
        for end in sorted({*ends_a} & {*ends_b}):
            groups.append(([i for i, e in zip(a, ends_a) if low < e <= end], [i for i, e in zip(b, ends_b) if low < e <= end]))
            low = end
        yield doc, len(a), len(b), groups


def plain_scores(rows, byte, piece):
    found = [(*x, Counter((a, b) for ga, gb in x[3] for a in ga for b in gb)) for x in plain_links(rows, byte, piece)]
    docs, best = Counter(), defaultdict(int)
    for x in found:
        docs.update(x[4].keys())
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    for doc, n_a, n_b, groups, own in found:
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        good = sum(m for p, m in own.items() if docs[p] == best[p[0]])
        yield doc, n_a, n_b, len(groups), sum(own.values()), good, sum(m * docs[p] for p, m in own.items()), hashlib.sha256(spelled.encode()).hexdigest() if spelled else ""


@pytest.mark.parametrize("options", [{}, {"chunk_rows": 7, "chunk_links": 50}, {"chunk_links": 1}])
def test_alignment_equals_brute_force(spark, plain_tokenizers, options):
    plain, _, piece = plain_tokenizers
    rows = [r for r in corpus(40) if r[0] not in (2000, 2001)] + [(3000 + k, t) for k, t in enumerate(ODD)] + [(5, "again and again"), (5, "again and again"), (None, None)]
    got = alignment.scores(frame(spark, rows).repartition(3), **options)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert order(tuple(r) for r in got.collect()) == order(plain_scores(rows, plain, piece))


def test_pairs_are_counted_over_all_rows(spark, plain_tokenizers):
    plain, _, piece = plain_tokenizers
    rows = [(k, t) for k, t in enumerate(ODD * 3)] + [(99, "x y z " * 400)]
    got = {(r.a, r.b): (r.n_docs, r.n_links) for r in alignment.pair_counts(frame(spark, rows).repartition(2), chunk_rows=5).collect()}
    docs, links = Counter(), Counter()
    for _, _, _, groups in plain_links(rows, plain, piece):
        own = Counter((a, b) for ga, gb in groups for a in ga for b in gb)
        docs.update(own.keys())
        links.update(own)
    assert got == {p: (n, links[p]) for p, n in docs.items()}
    empty = spark.createDataFrame([], EMPTY)
    assert alignment.scores(empty).count() == 0 and alignment.pair_counts(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 4), st.integers(0, 70)), st.integers(1, 300), min_size=1))
def test_postings_return_their_entries(entries):
    keys = np.array(sorted(entries), dtype=np.int64)
    links = np.array([entries[tuple(k)] for k in keys.tolist()], dtype=np.int64)
    pair, count, rows, planes = alignment.postings(keys[:, 0], keys[:, 1], links)
    row, back = alignment.unposted(rows, planes, count)
    assert np.repeat(pair, count).tolist() == keys[:, 0].tolist() and row.tolist() == keys[:, 1].tolist() and back.tolist() == links.tolist()
    assert alignment.link_count(planes, count).tolist() == [sum(m for (p, _), m in entries.items() if p == q) for q in pair.tolist()]


# ---- vector packing -----------------------------------------------------------


def wasted(lengths, tokens):
    """Padding of a sequence of so many ids."""
    return 0 if lengths & (lengths - 1) == 0 else tokens - lengths


def held_ids(rows, whole):
    return [(d, [*whole.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows]


def checked_packing(got, want, limits):
    """Every id in exactly one piece, places gapless, limits kept; returns the padding."""
    found = defaultdict(list)
    for r in got:
        found[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    expected = defaultdict(list)
    for doc, ids in want:
        expected[doc, len(ids)].append(ids)
    assert found.keys() == expected.keys()
    for key, texts in expected.items():
        if len(texts) > 1:  # repeated doc_ids: by their pieces' sums only
            assert sum(n for _, n, _ in found[key]) == sum(map(len, texts))
            continue
        at = 0
        for start, n, crc in sorted(found[key]):
            assert start == at and crc == zlib.crc32(np.array(texts[0][at : at + n], "<u4"))
            at += n
        assert at == len(texts[0])
    padding, sequences = 0, defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.concatenate([[0], np.cumsum([r.length for r in own])[:-1]]).tolist()
        size = sum(r.length for r in own)
        assert size <= limits.tokens and len(own) <= limits.segments and sum(r.loss_tokens for r in own) <= limits.most_loss
        padding += wasted(size, limits.tokens)
    return padding, len(sequences)


@pytest.mark.parametrize("limits", [Limits(128, 8), Limits(256, 2), Limits(2048, 1), Limits(64, 64, 40), Limits(128, 100, 7)])
@pytest.mark.parametrize("options", [{}, {"buffer_ids": 3000, "task_rows": 9}])
def test_cut_packing_wastes_nothing(spark, plain_tokenizers, limits, options):
    _, whole, _ = plain_tokenizers
    rows = [*corpus(40), *((4000 + k, None) for k in range(90)), (7, "again"), (7, None), (5000, "x <|endoftext|> y")]
    got = vector_packing.pack(frame(spark, rows).repartition(3), limits=limits, **options)
    padding, n = checked_packing(got.collect(), held_ids(rows, whole), limits)
    assert padding == 0
    if limits.segments >= 8 and limits.loss is None and not options:
        total = sum(len(x) for _, x in held_ids(rows, whole))
        assert n <= total // limits.tokens + 1 + limits.tokens.bit_length() + 100 // limits.segments


def test_packing_without_cuts_keeps_examples_whole(spark, plain_tokenizers):
    _, whole, _ = plain_tokenizers
    rows = [(k, " ".join(["word"] * (k % 50)), " ".join(["ask"] * (3 * k % 40))) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, question string").repartition(3)
    limits = Limits(96, 5, 60)
    got = vector_packing.pack(df, prompt="question", limits=limits, cut=False, keep_ids=True).collect()
    want = [(k, whole.encode(q, add_special_tokens=False).ids + whole.encode(t, add_special_tokens=False).ids + [1]) for k, t, q in rows]
    assert all(r.length == r.doc_tokens for r in got) and len(got) == 200
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got} == dict(want)
    assert {r.doc_id: r.loss_tokens for r in got} == {k: len(whole.encode(t, add_special_tokens=False).ids) + 1 for k, t, _ in rows}
    _, n = checked_packing(got, want, limits)
    least = max(sum(r.length for r in got) / 96, 200 / 5, sum(r.loss_tokens for r in got) / 60)
    assert n <= 1.15 * least + 4
    empty = spark.createDataFrame([], EMPTY)
    assert vector_packing.pack(empty).count() == 0
    with pytest.raises(ValueError, match="room"):
        Limits(0)


def test_dot_product_choice_equals_search():
    rng = random.Random(8)
    limits = Limits(100, 10, 50)
    for _ in range(30):
        pool = vector_packing.Pool(limits)
        pieces = [vector_packing.Piece(k, 0, np.zeros(n, np.uint32), n - min(n, rng.randint(0, 50)), n) for k in range(80) for n in [rng.randint(1, 99)]]
        for p in pieces:
            pool.add(p)
        room = (rng.randint(1, 100), rng.randint(1, 10), rng.randint(0, 50))
        total = np.array([sum(map(len, pieces)), len(pieces), sum(p.loss for p in pieces)]) / [100, 10, 50]
        value = lambda p: float((np.array([len(p), 1, p.loss]) / [100, 10, 50] * (np.array(room) / [100, 10, 50]) * total / total.sum()).sum())  # noqa: E731, B023
        fit = [p for p in pieces if len(p) <= room[0] and p.loss <= room[2]]
        got = pool.best(*room)
        assert (got is None) == (not fit) and (got is None or value(got) == pytest.approx(max(map(value, fit))))
        assert got is None or pool.pieces == 79


# ---- phrases ------------------------------------------------------------------


def plain_phrases(rows, least, longest=5, top=2000, contained=100):
    """Brute force over (text, lang)."""
    totals, grams = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", low(text)):
            w = re.findall(rb"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            grams.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    grams = {x: f for x, f in grams.items() if f >= least}
    out = []
    for (lang, w), a in grams.items():
        if len(w) == 1:
            continue
        inner = [f for (other, v), f in grams.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * f >= contained * a for f in inner):
            continue
        n = totals[lang]
        score, _, left, right = min((1000 * a * n // (grams[lang, w[:k]] * grams[lang, w[k:]]), k, grams[lang, w[:k]], grams[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, -score, -a, b" ".join(w), a, left, right, n, score))
    out.sort()
    ranks = Counter()
    for lang, _, _, phrase, *numbers in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            yield lang, ranks[lang], phrase.decode(), *numbers


def phrase_rows():
    rng = random.Random(4)
    pool = ["the", "of", "New", "york", "é", "x\x01", "漢字", *(f"w{k}" for k in range(20))]
    texts = [" ".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(60)]
    texts += ["New York City hall. the end"] * 9 + ["new  york\tcity HALL"] * 4 + ["a b, a b; a b: a b! a b? a b\na b\x0ba b\x0ca b\ra b"] * 3 + ["a a a a a a a a", "", " ", "...", None]
    return [(t, rng.choice(["en", "de", "und", None, ""])) for t in texts]


@pytest.mark.parametrize("options", [{}, {"partition_mass": 50, "flush": 60}, {"filter_bits": 4}, {"filter_bits": 9, "flush": 1}])
def test_phrases_equal_brute_force(spark, options):
    rows = phrase_rows()
    df = spark.createDataFrame([(k, t, lang, 1.0, "s") for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, score double, phrase string").repartition(3)
    for least, contained in ((5, 100), (3, 60)):
        got = phrases.phrases(df, least, contained=contained, top=25, **options)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert order(tuple(r) for r in got.collect()) == order(plain_phrases(rows, least, contained=contained, top=25))


def test_phrases_of_nothing(spark):
    assert phrases.phrases(spark.createDataFrame([], EMPTY)).count() == 0
    assert phrases.phrases(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string"), 1).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 40)), max_size=30), max_size=20), st.integers(1, 60), st.integers(1, 3))
def test_summary_keeps_every_frequent_key(runs, least, slack):
    total, mass = Counter(), 0
    for run in runs:
        for key, n in run:
            total[key] += n
            mass += n
    summary = phrases.Summary(slack * mass // least + 1)
    for run in runs:
        keys, counts = phrases.combined(np.array([k for k, _ in run], dtype=np.uint64), np.array([n for _, n in run], dtype=np.int64))
        back = phrases.unpacked(*phrases.packed(keys, counts))
        assert back[0].tolist() == keys.tolist() and back[1].tolist() == counts.tolist()
        summary.merge(keys, counts)
        summary.settle()
    assert summary.lost * (summary.capacity + 1) <= mass and summary.lost < least
    kept = dict(zip(summary.keys.tolist(), summary.counts.tolist()))
    assert all(n - summary.lost <= kept.get(k, 0) <= n for k, n in total.items())
    assert {k for k, n in total.items() if n >= least} <= set(summary.frequent(least).tolist())


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**13 + 7, 10**15 + 3, 10**13 + 9, 10**14 + 1), (10**17 - 1, 10**14, 10**17 - 1, 10**17 - 1), (3, 10, 7, 3), (100, 2**53 + 1, 101, 103)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = df.select("a", "n", "l", "r", phrases.exact_score(df.a, df.n, df.l, df.r).alias("s")).collect()
    assert [r.s for r in got] == [1000 * a * n // (left * right) for a, n, left, right in rows]
