"""Language-model scores of whole texts by context-tree weighting, beside a unigram base.

1. Tasks count the byte grams and the words of their texts and send distinct
   ones only; sums by key give the corpus counts.
2. Grams are dealt by the latest byte of their context. Below it a subtree is
   complete, so each task weights its own (``context_tree``); the at most 256
   times 255 nodes above them meet on the driver.
3. Every gram that any text has now has one log probability. Texts look their
   grams up in a table that goes to the tasks in shares of at most
   SHARE_GRAMS entries, and their words likewise; with several shares a text
   is read once for each and the parts are summed. So the model may grow with
   the corpus while what a task holds does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import context_tree
from .tables import keep, width
from .text import Texts, mix, signed, texts, word_hashes

DEPTH = 5
SHARE_GRAMS = 5_000_000
FLUSH = 3_000_000
SLICE_BYTES = 1 << 20  # a byte of a slice takes about 40 of arrays, and an executor holds a table and a slice for each core
END_WORD = np.uint64(0x5EED)  # stands for the end of a text among word hashes
_COUNTS = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("word", pa.bool_())])


def held_out(doc_id, folds: int = 7, fold: int = 2):
    """Whether crc32 of doc_id as text falls in the fold; a null doc_id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(folds)) == fold


def _grams(part: Texts, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of every byte and of the end (byte 0) of each text, and how many each text has. Before a text stand zeros."""
    sizes = np.diff(part.offsets)
    room = depth + 1
    wide = np.zeros(len(part.data) + room * len(part), dtype=np.uint64)
    wide[np.arange(len(part.data)) + np.repeat(np.arange(len(part)) * room + depth, sizes)] = part.data
    real = np.ones(len(wide), dtype=bool)
    begins = part.offsets[:-1] + np.arange(len(part)) * room
    for d in range(depth):
        real[begins + d] = False
    keys = wide.copy()
    for d in range(1, depth + 1):
        keys[d:] |= wide[:-d] << np.uint64(8 * (depth - d + 1))
    return keys[real], sizes + 1


def _counted(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    held: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {False: [], True: []}

    def shrink(word: bool) -> tuple[np.ndarray, np.ndarray]:
        # parts go as soon as they are joined, and joined arrays as soon as they are in order
        keys, n = map(np.concatenate, zip(*held[word]))
        held[word] = []
        order = np.argsort(keys)
        keys = keys[order]
        n = n[order]
        del order
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        held[word] = [(keys[first], np.add.reduceat(n, first))]
        return held[word][0]

    def send(word: bool) -> Iterator[pa.RecordBatch]:
        if held[word]:
            keys, n = shrink(word)
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(n), pa.array(np.full(len(n), word))], schema=_COUNTS)
        held[word] = []

    for batch in batches:
        for part in texts(batch.column("text"), lower=True, slice_bytes=SLICE_BYTES):
            train = ~batch.column("held_out").slice(part.first, len(part)).to_numpy(zero_copy_only=False)
            keys, counts = _grams(part, depth)
            keys, place = np.unique(keys << np.uint64(1) | np.repeat(train, counts), return_counts=True)
            held[False].append((keys >> np.uint64(1), np.where(keys & np.uint64(1), place, 0)))
            words = np.concatenate([word_hashes(part)[np.repeat(train, part.counts)], np.full(int(train.sum()), END_WORD)])
            held[True].append(np.unique(words, return_counts=True))
            for word in held:
                if sum(len(k) for k, _ in held[word]) > FLUSH:
                    # a task's distinct keys stay together until they are many
                    if len(shrink(word)[0]) > FLUSH // 2:
                        yield from send(word)
    for word in held:
        yield from send(word)


def _weigh(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def end(key: list[np.ndarray], n: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            grams = np.concatenate(key)
            chances, nodes = context_tree.subtree(grams, np.concatenate(n), depth)
            yield _packed(grams, False, chances.astype("<f4"))
            yield _packed(nodes[0], True, np.stack(nodes[1:], 1).astype("<f8"))

        latest, key, n = None, [], []
        for batch in batches:
            keys, counts = batch.column("key").to_numpy().view(np.uint64), batch.column("n").to_numpy()
            last = keys >> np.uint64(8 * depth)
            cuts = np.flatnonzero(last[1:] != last[:-1]) + 1
            for own, count in zip(np.split(keys, cuts), np.split(counts, cuts)):
                if len(own):
                    if latest is not None and latest != own[0] >> np.uint64(8 * depth):
                        yield from end(key, n)
                        key, n = [], []
                    latest = own[0] >> np.uint64(8 * depth)
                    key.append(own)
                    n.append(count)
        if key:
            yield from end(key, n)

    return run


def _packed(keys: np.ndarray, node: bool, values: np.ndarray) -> pa.RecordBatch:
    size = values.dtype.itemsize * values.shape[1]
    data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(keys), [None, pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(np.full(len(keys), node)), data], names=["key", "node", "data"])


def _values(column: pa.Array, kind: str, wide: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, wide)


class Table:
    """Values by 64-bit key, for up to ``room`` keys: open addressing, with 32 bits of the key kept beside each value."""

    def __init__(self, room: int, kind: str):
        self.size = 1 << max(4, int(np.ceil(np.log2(1.4 * max(1, room)))))
        self.marks, self.values = np.zeros(self.size, dtype=np.uint32), np.zeros(self.size, dtype=kind)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Put in distinct keys that are not there yet."""
        slot, mark = self._place(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.marks[slot[left]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.marks[slot[put]], self.values[slot[put]] = mark[put], values[put]
            done = np.zeros(len(keys), dtype=bool)
            done[put] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & (self.size - 1)

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys)
        return (h & np.uint64(self.size - 1)).astype(np.int64), (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, 0 where a key is not there, and which are there."""
        slot, mark = self._place(keys)
        out, there = np.zeros(len(keys), dtype=self.values.dtype), np.zeros(len(keys), dtype=bool)
        have = self.marks[slot]
        hit = have == mark
        out[hit], there[hit] = self.values[slot[hit]], True
        live = np.flatnonzero(~hit & (have != 0))
        while len(live):
            slot[live] = (slot[live] + 1) & (self.size - 1)
            have = self.marks[slot[live]]
            hit = have == mark[live]
            out[live[hit]], there[live[hit]] = self.values[slot[live[hit]]], True
            live = live[~hit & (have != 0)]
        return out, there


def _share(table: DataFrame, shares: int, k: int, value: str, kind: str) -> Table:
    """The ``k``-th share of a table, put in batch by batch to keep the driver's memory low."""
    own = table if shares == 1 else table.where(F.pmod(F.xxhash64("key"), F.lit(shares)) == k)
    rows = own.select("key", value).toArrow()
    out = Table(rows.num_rows, kind)
    for batch in rows.to_batches(max_chunksize=1 << 18):
        out.add(batch.column("key").to_numpy().view(np.uint64), batch.column(value).to_numpy().astype(kind))
    return out


def _score(depth: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words = sent.value
        for batch in batches:
            for part in texts(batch.column("text"), lower=True, slice_bytes=SLICE_BYTES):
                score, base, known = np.zeros(len(part)), np.zeros(len(part)), np.zeros(len(part), dtype=np.int64)
                if grams is not None:
                    keys, counts = _grams(part, depth)
                    score = np.add.reduceat(grams.get(keys)[0].astype(np.float64), np.cumsum(counts) - counts)
                if words is not None:
                    found, there = words.get(np.concatenate([word_hashes(part), [END_WORD]]))
                    gain = np.concatenate([[0.0], np.cumsum(np.log10(found[:-1] + 1.0))])
                    seen = np.concatenate([[0], np.cumsum(there[:-1])])
                    base = gain[part.bounds[1:]] - gain[part.bounds[:-1]] + np.log10(found[-1] + 1.0)
                    known = seen[part.bounds[1:]] - seen[part.bounds[:-1]] + there[-1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(part.first, len(part)), batch.column("doc_id").slice(part.first, len(part)), batch.column("held_out").slice(part.first, len(part)),
                     pa.array(part.counts + 1), pa.array(known), pa.array(base), pa.array(score), pa.array(np.diff(part.offsets))],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "n_bytes"],
                )

    return run


def score(docs: DataFrame, depth: int = DEPTH, folds: int = 7, fold: int = 2, share_grams: int = SHARE_GRAMS) -> DataFrame:
    """Each text's log10 probability, learned from the documents outside the held-out fold.

    ``docs`` has doc_id and text; other columns are left out. Returns doc_id,
    held_out, n_tokens (words and the end of the text), n_known (of them, in
    training), train_tokens, base_score (add-one unigrams over words), score
    (the context trees), n_bytes and bits_per_byte (code length of the bytes and the
    end). A-Z counts as a-z. A null text is empty; an empty text is its end alone. Repeated
    rows count and are scored each. Without training documents the base is 0 and every bit costs one.
    A byte 0 in a text counts as an end.
    """
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint"), "text", held_out("doc_id", folds, fold).alias("held_out"))
    counts = read.select("text", "held_out").mapInArrow(lambda b: _counted(b, depth), "key bigint, n bigint, word boolean")
    counts = keep(counts.groupBy("word", "key").agg(F.sum("n").alias("n")), "counts")
    words = counts.where("word")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()

    grams = counts.where("not word").select("key", "n", F.shiftright("key", 8 * depth).alias("latest"))
    dealt = grams.repartition(min(256, width(docs.sparkSession)), "latest").sortWithinPartitions("key").select("key", "n")
    weighed = keep(dealt.mapInArrow(_weigh(depth), "key bigint, node boolean, data binary"), "weighed")
    nodes = weighed.where("node").select("key", "data").toArrow().combine_chunks()
    values = _values(nodes["data"], "<f8", 3)
    stop, one = context_tree.root(nodes["key"].to_numpy().view(np.uint64), values[:, 0], values[:, 1], values[:, 2])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = b.column("key").to_numpy().view(np.uint64)
                found = context_tree.code(keys, _values(b.column("data"), "<f4", 8).astype(np.float64), stop, one)
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(found / np.log(10))], names=["key", "code"])

    codes = keep(weighed.where("not node").select("key", "data").mapInArrow(finish, "key bigint, code double"), "codes")
    n_grams = codes.count()
    shares = (max(1, -(-n_grams // share_grams)), max(1, -(-total.v // share_grams)))
    spark, parts = docs.sparkSession, []
    for k in range(max(shares)):
        sent = spark.sparkContext.broadcast((
            _share(codes, shares[0], k, "code", "f4") if k < shares[0] else None,
            _share(words, shares[1], k, "n", "u4") if k < shares[1] else None,
        ))
        parts.append(read.mapInArrow(_score(depth, sent), "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, n_bytes bigint"))
    found = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            found = found.unionByName(p)
        sums = [F.sum(c).alias(c) for c in ("n_known", "base", "score")]
        # an end or word that lies in another share adds log10(0 + 1) = 0 here
        found = found.groupBy("row", "doc_id", "held_out", "n_tokens", "n_bytes").agg(*sums)
    each = F.lit(float(np.log10(total.n + (total.v + 1))) if total.n else 0.0)
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total.n)).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * each).alias("base_score"), "score", "n_bytes",
        (-F.col("score") / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
