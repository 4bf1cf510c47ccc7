"""Best-fit packing of tokenised documents into sequences of one length.

Only lengths are packed, so the texts are tokenised once, where they are read,
and never shuffled: a piece is a row of a few numbers. The pieces are dealt
out evenly to tasks of bounded size; each packs its own by best fit and then
improves the packing by local search (``bins``). The few emptiest sequences of
each task are dealt out again, to fewer tasks, until one task has the last
rest, so the sequences lost to dealing do not grow with the number of tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bins
from .tables import keep
from .tokens import encoded, vocabulary

CAPACITY, END = 4096, 1
TASK_PIECES = 20_000
PASSED_ON = 4  # a task passes on its emptiest sequences, up to so many times a full one
_PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_PLACED = f"{_PIECE}, sequence_id bigint, offset bigint, level int"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Each document's ids and the end id, cut into pieces of ``capacity`` ids where longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.array([end], dtype="<u4")
        for batch in batches:
            first = 0
            for ids, offsets in encoded(batch.column("text"), path):
                rows: list[tuple[int, int, int, int, int]] = []
                for k in range(len(offsets) - 1):
                    own = np.concatenate([ids[offsets[k] : offsets[k + 1]], last])
                    for n, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        rows.append((first + k, n, at, len(part), zlib.crc32(part)))
                first += len(offsets) - 1
                which, *rest = map(list, zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()).take(pa.array(which)), pa.array(rest[0], pa.int32()), *(pa.array(x, pa.int64()) for x in rest[1:])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, _PIECE)


def _pack(held: DataFrame, tasks: int, level: int, capacity: int) -> DataFrame:
    """One round: each task packs its own pieces; level is -1 where a sequence is underfull and its pieces go on."""
    last = tasks == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = [b for b in batches if b.num_rows]
        if not own:
            return
        rows = pa.Table.from_batches(own).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = rows["length"].to_numpy()
        packed = bins.improve(lengths, bins.best_fit_decreasing(lengths, capacity), capacity)
        base = (level << 56) | (TaskContext.get().partitionId() << 32)
        order = np.array([i for b in packed for i in b])
        sizes = np.array([len(b) for b in packed])
        fills = np.add.reduceat(lengths[order], np.cumsum(sizes) - sizes)
        ends = np.cumsum(lengths[order])
        offset = ends - lengths[order] - np.repeat(np.cumsum(fills) - fills, sizes)
        emptiest = np.argsort(fills, kind="stable")
        goes_on = np.zeros(len(packed), dtype=bool)
        goes_on[emptiest] = np.cumsum(fills[emptiest]) <= PASSED_ON * capacity
        open_ = np.repeat(goes_on & (fills < capacity), sizes) & (not last)
        out = rows.take(pa.array(order))
        out = out.append_column("sequence_id", pa.array(base + np.repeat(np.arange(len(packed)), sizes), pa.int64()))
        out = out.append_column("offset", pa.array(offset, pa.int64()))
        yield from out.append_column("level", pa.array(np.where(open_, -1, level), pa.int32())).to_batches()

    return held.repartition(tasks).mapInArrow(run, _PLACED)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, task_pieces: int = TASK_PIECES) -> DataFrame:
    """Pieces of all documents placed in as few sequences of at most ``capacity`` ids as the search finds.

    ``docs`` has doc_id and text; other columns are left out. ``path`` is a
    tokenizer file. Returns doc_id, piece (from 0), start (ids of the document
    before it), length, ids_crc32 (of its ids as little-endian unsigned 32-bit
    numbers), sequence_id, offset (its place there, gapless from 0). A null or
    empty text is the end id alone. Rows that repeat a doc_id, or have none,
    are packed each on its own. No documents, no sequences.
    """
    held = keep(pieces(docs, path or vocabulary(), capacity, end), "pieces")
    # a full piece is a sequence; the others meet in tasks
    whole = held.where(F.col("length") == capacity)
    placed = whole.select(*held.columns, F.bitwise_not(F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest, level = held.where(F.col("length") < capacity), 1
    while True:
        count = rest.count()
        if not count:
            return placed
        tasks = max(1, count // task_pieces)
        done = keep(_pack(rest.select(*held.columns), tasks, level, capacity), "packed")
        placed = placed.unionByName(done.where("level >= 0").select(*placed.columns))
        rest, level = done.where("level < 0"), level + 1
