"""Token-id matrices: best-fit-decreasing packing where the documents are read.

Each task packs the documents of its own split, so nothing is shuffled and the
ids are made once. Pieces gather in a buffer; when it is full they are packed
best fit decreasing, with the tightest bin found in a segment tree over
capacities (``bins.Room``), full rows go out and the pieces of underfull rows
stay for the next round, as long as they fill no more than half the buffer:
beyond that the fullest rows go out as they are. A task so holds a buffer and
its longest document, however large its split, and leaves underfull rows only
at its end or where pieces do not fit together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bins
from .tokens import encoded, vocabulary

CAPACITY, END, PAD = 4096, 1, 0
BUFFER_IDS = 4 << 20
_ROW = pa.schema(
    [("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())),
     ("cu_seqlens", pa.list_(pa.int32())), ("ids", pa.binary()), ("positions", pa.binary())]
)


def packed_rows(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, pad: int = PAD, buffer_ids: int = BUFFER_IDS) -> DataFrame:
    """Rows of an id matrix with ``capacity`` columns.

    ``docs`` has doc_id and text; other columns are left out. Each document is
    its ids and the end id; one that is longer than a row is cut into pieces
    of whole rows and a rest, losing no id. Returns sequence_id, n_tokens (the
    rest of the row is ``pad``), doc_ids and pieces (of its segments, in
    order), cu_seqlens (0, then where each segment ends), ids and positions (a
    row of the matrix and of its position numbers, little-endian 32-bit;
    positions restart at 0 in each segment and in the padding). A null or empty text is the
    end id alone; a null doc_id stays null; rows that repeat a doc_id are packed each on its own.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[int | None, int, np.ndarray]] = []
        size, last = 0, np.array([end], dtype="<u4")

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, made
            rows, rest = [], []
            lengths = np.array([len(x[2]) for x in held], dtype=np.int64)
            packed = sorted(((int(lengths[b].sum()), b) for b in bins.best_fit_decreasing(lengths, capacity)), key=lambda x: -x[0])
            left = size
            for used, b in packed:
                own = [held[i] for i in b]
                # the fullest rows go out, full or not, until half the buffer is free
                if not final and used < capacity - capacity // 256 and left <= buffer_ids // 2:
                    rest += own
                    continue
                left -= used
                matrix, place = np.full(capacity, pad, dtype="<u4"), np.arange(capacity, dtype="<u4")
                cuts = np.cumsum([0, *(len(x[2]) for x in own)])
                matrix[:used] = np.concatenate([x[2] for x in own])
                place -= np.repeat(np.append(cuts[:-1], used), np.append(np.diff(cuts), capacity - used)).astype("<u4")
                rows.append((base + made, used, [x[0] for x in own], [x[1] for x in own], cuts.tolist(), matrix.tobytes(), place.tobytes()))
                made += 1
                if len(rows) == 128:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ROW.types)], schema=_ROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ROW.types)], schema=_ROW)
            held, size = rest, sum(len(x[2]) for x in rest)

        for batch in batches:
            names = iter(batch.column("doc_id").to_pylist())
            for ids, offsets in encoded(batch.column("text"), path):
                for b, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    doc, own = next(names), np.concatenate([ids[b:e], last])
                    held += [(doc, n, own[at : at + capacity]) for n, at in enumerate(range(0, len(own), capacity))]
                    size += len(own)
                    if size >= buffer_ids:
                        yield from flush(False)
        if held:
            yield from flush(True)

    kinds = "sequence_id bigint, n_tokens int, doc_ids array<bigint>, pieces array<int>, cu_seqlens array<int>, ids binary, positions binary"
    return docs.select("doc_id", "text").mapInArrow(run, kinds)


def write_matrices(docs: DataFrame, folder: str, **options) -> None:
    """Write the rows to ``folder`` as Parquet: the matrices by row, with segment lengths and documents beside them."""
    packed_rows(docs, **options).write.mode("errorifexists").parquet(folder)


def digest(rows: DataFrame) -> DataFrame:
    """The columns of the query: checksums in place of the matrices."""
    return rows.select(
        "sequence_id", F.col("n_tokens").cast("bigint").alias("n_tokens"), "doc_ids", "pieces", "cu_seqlens",
        F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"),
    )
