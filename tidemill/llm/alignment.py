"""Which tokens of two vocabularies stand for each other: inverted bitmaps of token pairs over all documents.

A byte-level vocabulary (A) and a piece vocabulary (B) cut the same bytes in
two ways. Places where tokens of both end cut a text into groups; every A token
of a group is linked with every B token of it. An id pair that is linked in
many documents is a good translation, and a document is judged by its pairs.

One pass over the texts turns them into *postings*. The rows of a task are
numbered in chunks of up to 65,536 rows; of each pair a chunk keeps the bitmap
of the rows that hold it linked (a list of 16-bit row numbers where that is
shorter) and bit planes of how often each of them does, one bit a row and
plane. Slices of a chunk are OR-merged before they are written. Chunks are
disjoint row ranges, so the OR of all bitmaps of a pair is their union and its
size the sum of their population counts; the planes give the link counts as
sums of 2^k times a population count. Counts meet the postings again by pair,
and the postings, dealt by chunk, return the scores to their rows.

The links of a text are those of its segments (``byte_tokens``), so tokens,
groups and links are made once for each distinct segment of a slice. Row
numbers follow the input splits; a lost task makes the same rows again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_tokens import ByteLevel, Coded, Pieces, Segments, byte_level, piece_level, runs, segments
from .tables import keep, width
from .tokens import vocabulary

CHUNK_ROWS = 1 << 16
CHUNK_LINKS = 1_500_000  # (row, pair) entries that a task holds before it writes a chunk
PASS_LINKS = 1_500_000  # links of one slice that are spelled out at a time
SLICE_BYTES = 3 << 20
_POSTED = pa.schema(
    [("chunk", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
     ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("n_rows", pa.int64()), ("rows", pa.binary()), ("planes", pa.binary())]
)
_KINDS = (
    "chunk bigint, place int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "a int, b int, n_rows bigint, rows binary, planes binary"
)


# ---- groups and links of the distinct segments of a slice ---------------------


@dataclass
class Aligned:
    """What each distinct segment of a slice contributes to a text that holds it."""

    good: np.ndarray  # whether both vocabularies give its bytes back
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    spelled: list[bytes]  # its groups as text, each group closed by a semicolon
    a: Coded
    b: Coded
    group_a: np.ndarray  # group of each A token
    count_b: np.ndarray  # B tokens of each group
    first_b: np.ndarray


def _picked(code: Coded, keep: np.ndarray) -> Coded:
    counts = np.where(keep, np.diff(code.begin), 0)
    return Coded(code.ids[runs(code.begin[:-1], counts)], np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))


def _digits(ids: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id in decimal and its sign behind it, in a matrix with unused cells in front, and the cells used."""
    powers = 10 ** np.arange(9, -1, -1)
    cells = np.empty((len(ids), 11), dtype=np.uint8)
    cells[:, :10] = ids[:, None] // powers % 10 + 48
    cells[:, 10] = signs
    used = np.concatenate([ids[:, None] >= powers, np.ones((len(ids), 1), dtype=bool)], axis=1)
    used[:, 9] = True
    return cells, used


def align(part: Segments, at: np.ndarray, byte: ByteLevel, piece: Pieces) -> Aligned:
    """Groups of the segments at the places ``at``; a segment that does not come back byte by byte has none."""
    a, (b, good) = byte.distinct(part, at), piece.distinct(part, at)
    a, b = _picked(a, good), _picked(b, good)
    ends_a, ends_b = np.cumsum(byte.entries.lengths[a.ids]), np.cumsum(piece.entries.lengths[b.ids])
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    count_a, count_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
    first_a, first_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b
    # the tokens in the order in which they are spelled: those of A, then those of B, group by group
    order = np.concatenate([np.arange(len(a.ids)) + first_b[group_a], np.arange(len(b.ids)) + (first_a + count_a)[group_b]]) if len(common) else np.zeros(0, np.int64)
    ids, signs = np.empty(len(order), dtype=np.int64), np.full(len(order), ord(","), dtype=np.uint8)
    ids[order] = np.concatenate([a.ids, b.ids])
    signs[(first_b + first_a + count_a - 1)] = ord("|")
    signs[(first_b + first_a + count_a + count_b - 1)] = ord(";")
    cells, used = _digits(ids, signs)
    text = cells[used].tobytes()
    cuts = np.concatenate([[0], np.cumsum(used.sum(1))])[a.begin + b.begin].tolist()
    last = np.searchsorted(common, np.cumsum(np.where(good, part.ends[at] - part.starts[at], 0)), "right")
    n_groups = np.diff(np.concatenate([[0], last]))
    links = np.concatenate([[0], np.cumsum(count_a * count_b)])
    return Aligned(
        good, np.diff(a.begin), np.diff(b.begin), n_groups, links[last] - links[last - n_groups], [text[x:y] for x, y in zip(cuts[:-1], cuts[1:])], a, b, group_a, count_b, first_b
    )


def _entries(x: Aligned, rows: np.ndarray, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, row, links) of a slice, sorted by pair and row, for its segments ``which`` of ``rows``; each pair comes in one part."""
    # equal segments of a row count once, with their number
    code = np.sort(rows * len(x.n_a) + which)
    head = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    times = np.diff(np.append(head, len(code)))
    rows, which = np.divmod(code[head], len(x.n_a)) if len(code) else (code, code)
    parts = max(1, -(-int(x.n_links[which].sum()) // PASS_LINKS))
    for k in range(parts):
        # the links of each distinct segment, where A's id falls to this part
        mine = x.a.ids % parts == k
        upto = np.concatenate([[0], np.cumsum(np.where(mine, x.count_b[x.group_a], 0))])
        chosen = np.flatnonzero(mine)
        count = x.count_b[x.group_a[chosen]]
        pairs = (np.repeat(x.a.ids[chosen], count) << 32) | x.b.ids[runs(x.first_b[x.group_a[chosen]], count)]
        begin = upto[x.a.begin]
        names, pairs = np.unique(pairs, return_inverse=True)
        many = np.diff(begin)[which]
        if not many.sum():
            continue
        span = int(rows.max()) + 1
        key = pairs[runs(begin[:-1][which], many)] * span + np.repeat(rows, many)
        weight = np.repeat(times, many)
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        pair, row = np.divmod(key[heads], span)
        yield names[pair], row, np.add.reduceat(weight, heads)


# ---- postings -----------------------------------------------------------------


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of runs of ``sizes`` bytes."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def postings(pair: np.ndarray, row: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Of entries sorted by pair and row: the pairs, their numbers of rows, and the rows and multiplicity planes of each.

    Rows are a list of 16-bit numbers, or a bitmap where that is shorter (then
    the first byte tells: a list has an even number of bytes, a bitmap an odd
    one). Plane k holds bit k of (links - 1), a bit for each row of the list.
    """
    head = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    count = np.diff(np.append(head, len(pair)))
    room = int(row.max()) // 8 + 1
    room += 1 - room % 2
    dense = 2 * count > room
    sizes = np.where(dense, room, 2 * count)
    data = np.zeros(int(sizes.sum()), dtype=np.uint8)
    begin = np.cumsum(sizes) - sizes
    mine = np.repeat(dense, count)
    at = runs(begin[~dense], sizes[~dense])
    data[at] = row[~mine].astype("<u2").view(np.uint8)
    which = np.repeat(np.arange(len(head)), count)
    np.bitwise_or.at(data, begin[which[mine]] + (row[mine] >> 3), (1 << (row[mine] & 7)).astype(np.uint8))
    more = links - 1
    most = np.maximum.reduceat(more, head)
    depth = np.where(most > 0, np.floor(np.log2(np.maximum(most, 1))).astype(np.int64) + 1, 0)
    one = (count + 7) // 8
    base = np.cumsum(depth * one) - depth * one
    bits = np.zeros(8 * int((depth * one).sum()), dtype=bool)
    rank = np.arange(len(pair)) - np.repeat(head, count)
    for k in range(int(depth.max())):
        held = np.flatnonzero((more >> k) & 1)
        p = which[held]
        bits[8 * (base[p] + k * one[p]) + rank[held]] = True
    return pair[head], count, _binary(data, sizes), _binary(np.packbits(bits, bitorder="little"), depth * one)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and sizes of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8)[places[0] : places[-1]] if data is not None else np.zeros(0, np.uint8)), np.diff(places)


def unposted(rows: pa.Array, planes: pa.Array, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, links) of all entries, posting after posting."""
    data, sizes = _flat(rows)
    begin, first = np.cumsum(sizes) - sizes, np.cumsum(count) - count
    out = np.empty(int(count.sum()), dtype=np.int64)
    dense = sizes % 2 == 1
    at = runs(begin[~dense], sizes[~dense])
    out[runs(first[~dense], count[~dense])] = np.ascontiguousarray(data[at]).view("<u2")
    for k in np.flatnonzero(dense).tolist():
        out[first[k] : first[k] + count[k]] = np.flatnonzero(np.unpackbits(data[begin[k] : begin[k] + sizes[k]], bitorder="little"))
    data, sizes = _flat(planes)
    bits, one = np.unpackbits(data, bitorder="little"), (count + 7) // 8
    base, depth = np.cumsum(sizes) - sizes, sizes // one
    links = np.ones(len(out), dtype=np.int64)
    for k in range(int(depth.max()) if len(depth) else 0):
        p = np.flatnonzero(depth > k)
        places = runs(8 * (base[p] + k * one[p]), count[p])
        links[runs(first[p], count[p])] += bits[places].astype(np.int64) << k
    return out, links


def link_count(planes: pa.Array, count: np.ndarray) -> np.ndarray:
    """Links of each posting: its rows, and 2^k for each bit of plane k."""
    data, sizes = _flat(planes)
    base = np.cumsum(sizes) - sizes
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(data))]).astype(np.int64)
    one, total = (count + 7) // 8, count.astype(np.int64)
    depth = sizes // one
    for k in range(int(depth.max()) if len(depth) else 0):
        p = np.flatnonzero(depth > k)
        b = base[p] + k * one[p]
        total[p] += (ones[b + one[p]] - ones[b]) << k
    return total


def posted(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, chunk_rows: int = CHUNK_ROWS, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """Facts of every row (``a`` null) and the postings of every chunk (``place`` null), in one kept table."""
    byte_path, piece_path = byte_path or vocabulary("byte_bpe_50k.json"), piece_path or vocabulary("piece_bpe_32k.model")

    def table(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _POSTED], schema=_POSTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        byte, piece = byte_level(byte_path), piece_level(piece_path)
        chunk, used, size = TaskContext.get().partitionId() << 32, 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, used, size, held
            if held:
                pair, row, links = map(np.concatenate, zip(*held))
                order = np.argsort(pair, kind="stable")  # rows already rise from slice to slice
                pair, count, rows, planes = postings(pair[order], row[order], links[order])
                for i in range(0, len(pair), 20_000):
                    n = min(20_000, len(pair) - i)
                    own = pair[i : i + n]
                    yield table(n, chunk=np.full(n, chunk), a=own >> 32, b=own & 0xFFFFFFFF, n_rows=count[i : i + n], rows=rows.slice(i, n), planes=planes.slice(i, n))
            chunk, used, size, held = chunk + 1, 0, 0, []

        for batch in batches:
            for part in segments(batch.column("text"), b" ", SLICE_BYTES):
                n = len(part)
                if used + n > chunk_rows:
                    yield from flush()
                at, which = part.distinct()
                x = align(part, at, byte, piece)
                rows = np.repeat(np.arange(n), np.diff(part.bounds))
                bad = np.zeros(n, dtype=bool)
                bad[rows[~x.good[which]]] = True
                counts = [np.where(bad, 0, np.concatenate([[0], np.cumsum(c[which])])[part.bounds[1:]] - np.concatenate([[0], np.cumsum(c[which])])[part.bounds[:-1]]) for c in (x.n_a, x.n_b, x.n_groups, x.n_links)]
                digests, own, bounds = [], which.tolist(), part.bounds.tolist()
                for k in range(n):
                    text = b"" if bad[k] else b"".join([x.spelled[s] for s in own[bounds[k] : bounds[k + 1]]])
                    digests.append(hashlib.sha256(text[:-1]).hexdigest() if text else "")
                yield table(
                    n, chunk=np.full(n, chunk), place=np.arange(used, used + n), doc_id=batch.column("doc_id").cast(pa.int64()).slice(part.first, n),
                    n_a=counts[0], n_b=counts[1], n_groups=counts[2], n_links=counts[3], groups_sha256=digests,
                )
                fine = ~bad[rows]
                for pair, row, links in _entries(x, rows[fine], which[fine]):
                    held.append((pair, (row + used).astype(np.int32), links.astype(np.int32)))
                    size += len(pair)
                used += n
                if size >= chunk_links:
                    yield from flush()
        yield from flush()

    return keep(docs.select("doc_id", "text").mapInArrow(run, _KINDS), "postings")


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count = batch.column("n_rows").to_numpy()
        links = link_count(batch.column("planes"), count) if len(count) else count
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("n_rows"), pa.array(links, pa.int64())], names=["a", "b", "n_docs", "n_links"])


def _counts(held: DataFrame) -> DataFrame:
    sums = held.where("place IS NULL").select("a", "b", "n_rows", "planes").mapInArrow(_linked, "a int, b int, n_docs bigint, n_links bigint")
    sums = sums.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    # the pairs of one A id are at most as many as B has ids
    return sums.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a")))


def pair_counts(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, **options: int) -> DataFrame:
    """The alignment itself: a, b, n_docs (rows that hold the pair linked), n_links, best (no pair of the A id is in more rows)."""
    return _counts(posted(docs, byte_path, piece_path, **options))


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each row from postings that come chunk by chunk."""
    now, sums, best = None, np.zeros(CHUNK_ROWS, np.int64), np.zeros(CHUNK_ROWS, np.int64)

    def out() -> pa.RecordBatch:
        place = np.flatnonzero(sums)
        done = pa.RecordBatch.from_arrays([pa.array(np.full(len(place), now), pa.int64()), pa.array(place, pa.int32()), pa.array(sums[place]), pa.array(best[place])], names=["chunk", "place", "count_sum", "n_best"])
        sums[:] = best[:] = 0
        return done

    for batch in batches:
        chunks = batch.column("chunk").to_numpy()
        if not len(chunks):
            continue
        cuts = np.concatenate([[0], np.flatnonzero(chunks[1:] != chunks[:-1]) + 1, [len(chunks)]]).tolist()
        for x, y in zip(cuts[:-1], cuts[1:]):
            if now is not None and chunks[x] != now:
                yield out()
            now = int(chunks[x])
            for i in range(x, y, 2_000):
                own = batch.slice(i, min(2_000, y - i))
                count = own.column("n_rows").to_numpy()
                row, links = unposted(own.column("rows"), own.column("planes"), count)
                np.add.at(sums, row, links * np.repeat(own.column("n_docs").to_numpy(), count))
                np.add.at(best, row, links * np.repeat(own.column("best").to_numpy(zero_copy_only=False), count))
    if now is not None:
        yield out()


def scores(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, **options: int) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a and n_b (tokens), n_groups, n_links, n_best, count_sum, groups_sha256.

    ``docs`` has doc_id and text; other columns are left out, whatever their
    names. n_best counts the links whose pair no other pair of the same A id
    exceeds in documents, ties included; count_sum adds the documents of the
    pair over all links. groups_sha256 is the digest of the groups in decimal
    ids (``a1,a2|b1;a3|b2,b3``). A null or empty text, and one that either
    vocabulary does not give back byte by byte (as with U+2581), has no tokens:
    zeros and an empty digest. A document is a row: rows that repeat a doc_id,
    or have none, count each on its own. No rows, no result.
    """
    held = posted(docs, byte_path, piece_path, **options)
    counts = _counts(held).select("a", "b", "n_docs", "best")
    lists = held.where("place IS NULL").select("chunk", "a", "b", "n_rows", "rows", "planes")
    dealt = lists.join(counts, ["a", "b"]).repartition(width(docs.sparkSession), "chunk").sortWithinPartitions("chunk")
    sums = dealt.select("chunk", "n_rows", "rows", "planes", "n_docs", "best").mapInArrow(_returned, "chunk bigint, place int, count_sum bigint, n_best bigint")
    facts = held.where("a IS NULL").select("chunk", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return facts.join(sums, ["chunk", "place"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).cast("bigint").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("bigint").alias("count_sum"), "groups_sha256",
    )
