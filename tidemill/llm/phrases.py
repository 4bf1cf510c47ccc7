"""Phrases whose words keep company more often than chance, over all texts of a language.

A phrase of two to five words must occur ``least`` times. Its n-grams are found
in three reads of the texts:

1. Words and n-gram occurrences are counted. Their number sets how many hash
   partitions and how many bits of a hash are needed, so both grow with the
   input.
2. Every task combines the n-grams it holds (one to five words, by language)
   and sends each hash partition its sorted hashes and counts, packed in a few
   bytes each. A partition merges them into one Misra-Gries summary whose
   capacity is ``SLACK`` times the partition's mass divided by ``least``: no
   n-gram can have lost ``least / SLACK`` of its count, so every frequent one
   survives, whatever else the partition holds. Its mass is known before its
   first run comes, because each task sends it ahead.
3. The survivors make a bitmap of fixed size. Every task counts, exactly and
   with their words, the n-grams that are in it and whose own parts are in it,
   and sends them by hash partition, many to a row; the partition adds the counts
   by language and phrase. What the bitmap lets through by chance goes with the
   exact count.

Each row meets only sums by key; of a hot n-gram a task sends one row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import keep, small, width
from .text import _LOWER, _buffers, gram_hashes, mix, span_hashes

LEAST, LONGEST, TOP, CONTAINED = 100, 5, 2000, 100
SLACK = 4
SLICE_BYTES = 2 << 20
FLUSH_GRAMS = 2_000_000  # n-gram hashes that a task combines at a time
ROW_PHRASES = 100
ROW_KEYS = 500  # hashes in a row that is sent, so that a batch of rows stays small
FLUSH_PHRASES = 400_000  # counted phrases that a task holds, about 80 MB
PARTITION_MASS = 100_000_000  # n-gram occurrences in a hash partition, on average
FILTER_BITS = 27  # the bitmap of survivors has 2^27 bits, 16 MB
SPARE_BITS = 10  # bits of a hash beyond those that tell the occurrences apart
UNKNOWN = "und"
# What separates pieces of a text, and words of a piece.
_BREAK, _GAP = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)]), np.isin(np.arange(256), [0x20, 0x09])


# ---- words of texts -----------------------------------------------------------


@dataclass
class Bitmap:
    """A bit for each range of 64-bit hashes, ``size`` bits of which tell the range."""

    bits: np.ndarray
    size: int

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - self.size)
        return (self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


@dataclass
class Words:
    """The words of some texts: their bytes, languages, and how many words are left in the piece from each on."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    left: np.ndarray
    lang: np.ndarray  # number of the language of each word
    names: list[str]

    def hashes(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, places, hashes) of the n-grams of each size."""
        if not len(self.starts):
            return
        words = span_hashes(self.data, self.starts, self.ends)
        own = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.names], dtype=np.uint64)
        for size in range(1, longest + 1):
            grams = gram_hashes(words, size)
            at = np.flatnonzero(self.left[: len(grams)] >= size)
            yield size, at, mix(grams[at] ^ (own[self.lang[at]] + np.uint64(size)))


def words(batch: pa.RecordBatch, slice_bytes: int = SLICE_BYTES) -> Iterator[Words]:
    """The words of the columns text and lang, A-Z in lower case, in slices of bounded size."""
    if not batch.num_rows:
        return
    data, places = _buffers(batch.column("text"))
    langs = batch.column("lang").cast(pa.string()).fill_null(UNKNOWN).dictionary_encode()
    names, which = langs.dictionary.to_pylist(), langs.indices.to_numpy()
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(places, places[i] + slice_bytes, "right")) - 1)
        own, offsets = _LOWER[data[places[i] : places[j]]], places[i : j + 1] - places[i]
        stop = _BREAK[own]
        solid = ~(stop | _GAP[own])
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        held = np.diff(offsets) > 0
        edges, last = offsets[:-1][held], offsets[1:][held] - 1
        begin[edges], end[last] = solid[edges], solid[last]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        text = np.repeat(np.arange(j - i), np.diff(np.searchsorted(starts, offsets)))
        piece = np.cumsum(stop)[starts] if len(starts) else starts
        new = np.ones(len(starts) + 1, dtype=bool)
        new[1:-1] = (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])
        heads = np.flatnonzero(new)
        left = np.repeat(heads[1:], np.diff(heads)) - np.arange(len(starts))
        yield Words(own, starts, ends, left, which[i:j][text], names)
        i = j


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def word_counts(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """lang, n (words) and mass (occurrences of one to ``longest`` words in a row) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words(batch):
                if len(part.starts):
                    k = len(part.names)
                    n, mass = np.bincount(part.lang, minlength=k), np.bincount(part.lang, weights=np.minimum(part.left, longest), minlength=k).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(part.names), pa.array(n), pa.array(mass)], names=["lang", "n", "mass"])

    return _texts(docs).mapInArrow(run, "lang string, n bigint, mass bigint").groupBy("lang").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass")).where("n > 0")


# ---- summaries ----------------------------------------------------------------


def _narrow(values: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs; the first byte tells how many."""
    size = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return bytes([size]) + np.ascontiguousarray(np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    size = raw[0]
    out = np.zeros((max(0, len(raw) - 1) // size, 8), dtype=np.uint8)
    out[:, :size] = np.frombuffer(raw, dtype=np.uint8, offset=1).reshape(-1, size)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def packed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted distinct keys as differences; counts only where they are not 1, with their places."""
    more = np.flatnonzero(counts > 1)
    return _narrow(np.diff(keys, prepend=np.uint64(0))), _narrow(np.diff(more.astype(np.uint64), prepend=np.uint64(0))), _narrow(counts[more].astype(np.uint64))


def unpacked(keys: bytes, places: bytes, more: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = np.cumsum(_wide(keys), dtype=np.uint64)
    counts = np.ones(len(found), dtype=np.int64)
    at = np.cumsum(_wide(places), dtype=np.uint64).astype(np.int64)
    counts[at] = _wide(more).astype(np.int64)
    return found, counts


def combined(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts (1 each if none are given)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[head], np.diff(np.append(head, len(keys))) if counts is None else np.add.reduceat(counts, head)


class Summary:
    """A Misra-Gries summary that merges counted runs: no count is ever too large, and none too small by more than ``lost``."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = max(1, capacity), 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > max(self.capacity, 500_000):
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        keys, counts = map(np.concatenate, zip((self.keys, self.counts), *self.waiting))
        self.waiting, self.size = [], 0
        self.keys, self.counts = combined(keys, counts)
        over = len(self.keys) - self.capacity
        if over > 0:  # take the largest count beyond the capacity off all
            cut = int(np.partition(self.counts, over - 1)[over - 1])
            live = self.counts > cut
            self.keys, self.counts, self.lost = self.keys[live], self.counts[live] - cut, self.lost + cut

    def frequent(self, least: int) -> np.ndarray:
        """All keys that may have occurred ``least`` times."""
        self.settle()
        return self.keys[self.counts + self.lost >= least]


def hash_bits(mass: int) -> int:
    """Bits of a hash that tell so many occurrences apart, and some more."""
    return min(64, max(32, max(1, mass).bit_length() + SPARE_BITS))


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Hash partitions are ranges of 64-bit hashes."""
    return (((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def survivors(docs: DataFrame, mass: int, parts: int, least: int = LEAST, longest: int = LONGEST, flush: int = FLUSH_GRAMS) -> tuple[DataFrame, int]:
    """Every n-gram that may occur ``least`` times, of ``mass`` occurrences in all: the first bits of their hashes, as numbers in binary rows, and how many bits."""
    bits = hash_bits(mass)
    shift = np.uint64(64 - bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(parts, dtype=np.int64)
        held, size = [], 0

        def run() -> pa.RecordBatch:
            nonlocal held, size
            keys, counts = combined(np.concatenate(held))
            held, size = [], 0
            where = part_of(keys << shift, parts)
            np.add.at(sums, where, counts)
            heads = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
            rank = np.arange(len(keys)) - np.repeat(heads, np.diff(np.append(heads, len(keys))))
            cuts = [*np.flatnonzero(rank % ROW_KEYS == 0).tolist(), len(keys)]
            rows = [(int(where[x]), False, 0, *packed(keys[x:y], counts[x:y])) for x, y in zip(cuts[:-1], cuts[1:])]
            return table(rows)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["part", "ahead", "mass", "keys", "places", "more"])

        for batch in batches:
            for piece in words(batch):
                for _, _, hashes in piece.hashes(longest):
                    held.append(hashes >> shift)
                    size += len(hashes)
                if size >= flush:
                    yield run()
        if size:
            yield run()
        ahead = np.flatnonzero(sums).tolist()
        if ahead:
            yield table([(p, True, int(sums[p]), None, None, None) for p in ahead])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, summary = -1, 0, None

        def out() -> pa.RecordBatch:
            found = summary.frequent(least)
            return pa.RecordBatch.from_arrays([pa.array([found.astype("<u8").tobytes()])], names=["keys"])

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                columns = [batch.column(c).slice(i, 64).to_pylist() for c in ("part", "ahead", "mass", "keys", "places", "more")]
                for part, ahead, own, *run in zip(*columns):
                    if part != now:
                        if summary is not None:
                            yield out()
                        now, total, summary = part, 0, None
                    if ahead:
                        total += own
                        continue
                    if summary is None:
                        summary = Summary(SLACK * total // least + 1)
                    summary.merge(*unpacked(*run))
        if summary is not None:
            yield out()

    sent = _texts(docs).mapInArrow(send, "part bigint, ahead boolean, mass bigint, keys binary, places binary, more binary")
    dealt = sent.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", F.desc("ahead"))
    return dealt.mapInArrow(merge, "keys binary"), bits


def bitmap(found: DataFrame, bits: int, filter_bits: int = FILTER_BITS) -> Bitmap:
    """A bit for each range of hashes that holds a survivor: at most 2^``filter_bits`` bits, however many there are."""
    size = min(bits, filter_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("keys"):
                at = np.unique(np.frombuffer(raw.as_py(), dtype="<u8") >> np.uint64(bits - size))
                for part in np.split(at, np.flatnonzero(np.diff(at >> np.uint64(23))) + 1):  # rows of at most a MB
                    if not len(part):
                        continue
                    first = int(part[0]) >> 3
                    own = np.zeros((int(part[-1]) >> 3) - first + 1, dtype=np.uint8)
                    np.bitwise_or.at(own, (part >> np.uint64(3)).astype(np.int64) - first, (1 << (part & np.uint64(7)).astype(np.int64)).astype(np.uint8))
                    listed = _narrow(np.diff(part, prepend=np.uint64(0)))
                    dense = len(own) <= len(listed)
                    yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([dense]), pa.array([own.tobytes() if dense else listed])], names=["first", "dense", "own"])

    out = np.zeros(1 << max(0, size - 3), dtype=np.uint8)
    for first, dense, own in found.mapInArrow(run, "first bigint, dense boolean, own binary").collect():
        if dense:
            part = np.frombuffer(own, dtype=np.uint8)
            out[first : first + len(part)] |= part
        else:
            at = np.cumsum(_wide(bytes(own)), dtype=np.uint64)
            np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.int64)).astype(np.uint8))
    return Bitmap(out, size)


# ---- exact counts -------------------------------------------------------------


_PACKED = pa.schema([("part", pa.int32()), ("langs", pa.list_(pa.string())), ("phrases", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """A column; texts may come as bytes."""
    return pa.array(values, pa.binary()).cast(kind) if isinstance(values[0], bytes) else pa.array(values, kind)


def frequent(
    docs: DataFrame, mass: int, least: int = LEAST, longest: int = LONGEST, filter_bits: int = FILTER_BITS, partition_mass: int = PARTITION_MASS, flush: int = FLUSH_GRAMS
) -> DataFrame:
    """lang, phrase (words joined by a space), size and f of every n-gram with f (occurrences) of ``least`` or more; kept."""
    parts = max(3 * width(docs.sparkSession), -(-mass // partition_mass))
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(*survivors(docs, mass, parts, least, longest, flush), filter_bits))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}  # hash -> place in the lists
        langs, texts, sizes, sums = [], [], [], []
        found = sent.value

        def out() -> Iterator[pa.RecordBatch]:
            where = part_of(np.fromiter(held, dtype=np.uint64, count=len(held)), parts)
            order = np.argsort(where, kind="stable")
            where = where[order]
            columns = [_column(c, f.type.value_type).take(pa.array(order)) for c, f in zip((langs, texts, sizes, sums), list(_PACKED)[1:])]
            for x in (held, langs, texts, sizes, sums):
                x.clear()
            heads = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
            rank = np.arange(len(where)) - np.repeat(heads, np.diff(np.append(heads, len(where))))
            cuts = np.append(np.flatnonzero(rank % ROW_PHRASES == 0), len(where)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(where[cuts[:-1]], pa.int32()), *(pa.ListArray.from_arrays(pa.array(cuts), c) for c in columns)], schema=_PACKED)

        for batch in batches:
            for part in words(batch):
                raw, shorter = part.data.tobytes(), None
                for k, at, hashes in part.hashes(longest):
                    there = found.holds(hashes)
                    if shorter is not None:
                        there &= shorter[at] & shorter[at + 1]
                    shorter = np.zeros(len(part.starts) + 1, dtype=bool)
                    shorter[at[there]] = True
                    own, first, counts = np.unique(hashes[there], return_index=True, return_counts=True)
                    places = at[there][first]
                    for h, b, e, lang, n in zip(own.tolist(), part.starts[places].tolist(), part.ends[places + k - 1].tolist(), part.lang[places].tolist(), counts.tolist()):
                        known = held.get(h)
                        if known is None:
                            text = raw[b:e]
                            if k > 1 and (b"  " in text or b"\t" in text):
                                text = b" ".join(text.split())
                            held[h] = len(sums)
                            langs.append(part.names[lang])
                            texts.append(text)
                            sizes.append(k)
                            sums.append(n)
                        else:
                            sums[known] += n
                    if len(held) >= FLUSH_PHRASES:
                        yield from out()
        if held:
            yield from out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            for entry in zip(*(batch.column(c).flatten().to_pylist() for c in ("langs", "phrases", "sizes", "counts"))):
                known = sums.setdefault(entry[:2], [entry[2], 0])
                known[1] += entry[3]
        rows = [(lang, phrase, size, f) for (lang, phrase), (size, f) in sums.items() if f >= least]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["lang", "phrase", "size", "f"])

    rows = _texts(docs).mapInArrow(send, "part int, langs array<string>, phrases array<string>, sizes array<int>, counts array<bigint>")
    counts = keep(rows.repartitionById(parts, F.col("part")).mapInArrow(add, "lang string, phrase string, size long, f bigint"), "frequent")
    sent.unpersist()
    return counts


def _with_counts(cuts: DataFrame, grams: DataFrame, part: str, one: Column, name: str) -> DataFrame:
    """The counts of the phrases in column ``part``, which are single words where ``one`` holds: the most shared parts meet a small table."""
    counts = grams.select("lang", F.col("phrase").alias(part), F.col("f").alias(name), "size")
    single = cuts.where(one).join(small(counts.where("size = 1").drop("size"), "words"), ["lang", part])
    return single.unionByName(cuts.where(~one).join(counts.where("size > 1").drop("size"), ["lang", part]))


def exact_score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 a n / (l r)) by decimals of 38 digits: enough for counts up to 10^17."""
    wide = lambda c: c.cast("decimal(18,0)")
    top = (wide(a) * wide(n)).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (wide(l) * wide(r)).cast("decimal(38,0)"))


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, contained: int = CONTAINED, **options: int) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has text and lang; other columns are left out. Texts in lower case
    (A-Z) are split into pieces at ``. , ; : ! ?`` and line ends, pieces into
    words at spaces and tabs. n counts the words of the language, a the
    occurrences of the phrase within pieces, overlaps included; phrases of 2 to
    ``longest`` words with a >= ``least`` are candidates. Cut after k words, l
    and r are the occurrences of its parts, and the score is
    floor(1000 a n / (l r)); the cut with the lowest score counts, of several the
    first. A candidate that lies in a longer one with at least ``contained``
    percent of its occurrences goes. Order: score and a descending, then the
    phrase by bytes. A null text has no words, a null lang is ``und``; repeated
    rows count each; without texts there is no row.
    """
    totals = keep(word_counts(docs, longest), "words")
    mass = totals.agg(F.sum("mass")).first()[0] or 0
    grams = frequent(docs, mass, least, longest, **options)
    found = grams.where("size > 1")
    parts = F.split("phrase", " ")
    cuts = found.select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), (F.col("size") - 1).cast("int"))).alias("k"))
    cuts = cuts.withColumns({"first": F.array_join(F.slice(parts, F.lit(1), F.col("k")), " "), "rest": F.array_join(F.slice(parts, F.col("k") + 1, F.col("size").cast("int")), " ")})
    cuts = _with_counts(cuts, grams, "first", F.col("k") == 1, "l")
    cuts = _with_counts(cuts, grams, "rest", F.col("k") == F.col("size") - 1, "r")
    cuts = cuts.join(small(totals.select("lang", "n"), "langs"), "lang").withColumn("score", exact_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best")).select("lang", "phrase", "best.*")
    # all runs of words within longer candidates
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), (F.col("size") - 1).cast("int")), lambda n: F.transform(F.sequence(F.lit(1), (F.col("size") - n + 1).cast("int")), lambda s: F.array_join(F.slice(parts, s, n), " ")))))
    longer = found.where("size > 2").select("lang", "f", inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * contained))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = left.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
