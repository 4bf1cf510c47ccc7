"""Which keys occur in more than one document: one shuffle, no group held in memory.

Each task first combines its own rows: of a key it sends one row, that of its
smallest document, and marks the others on the spot. A key that a third of all
documents hold thus meets in one place with one row a task. The rows of a key
then stand sorted by document, and one pass over the partition marks them,
holding no more than the current key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import mix, signed

FLUSH = 2_000_000  # key rows a task combines at a time
SENT = "deal bigint, key bigint, doc_id bigint, asks boolean, marked boolean"
_SENT = pa.schema([("deal", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("asks", pa.bool_()), ("marked", pa.bool_())])
_OUT = pa.schema([("doc_id", pa.int64()), ("key", pa.int64())])

Emitter = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]


def _combine(keys: np.ndarray, docs: np.ndarray, first_too: bool) -> pa.RecordBatch:
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    keys, docs = keys[fresh], docs[fresh]
    head = np.ones(len(keys), dtype=bool)
    head[1:] = keys[1:] != keys[:-1]
    marked = ~head
    if first_too:
        marked[:-1] |= marked[1:] & head[:-1]
    deal = np.where(head, keys.view(np.int64), signed(mix(docs.view(np.uint64).copy())))
    return pa.RecordBatch.from_arrays(
        [pa.array(deal), pa.array(keys.view(np.int64)), pa.array(docs), pa.array(head), pa.array(marked)], schema=_SENT
    )


def shared_keys(df: DataFrame, emit: Emitter, first_too: bool) -> DataFrame:
    """(doc_id, key) of keys that more than one document holds; without ``first_too``, not for the smallest doc_id that has the key.

    ``emit`` gives (hashes, doc_ids) arrays of a batch of ``df``. Rows may repeat in the result.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for pair in emit(batch):
                held.append(pair)
                size += len(pair[0])
                if size >= FLUSH:
                    yield _combine(*map(np.concatenate, zip(*held)), first_too)
                    held, size = [], 0
        if size:
            yield _combine(*map(np.concatenate, zip(*held)), first_too)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, told = None, 0, False  # of the key at hand
        for batch in batches:
            keys, docs, asks, marked = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "doc_id", "asks", "marked"))
            out = [(docs[marked], keys[marked])]
            keys, docs = keys[asks], docs[asks]
            if len(keys):
                head = np.ones(len(keys), dtype=bool)
                head[1:] = keys[1:] != keys[:-1]
                head[0] = key is None or keys[0] != key
                run = np.cumsum(head) - head[0]
                heads = np.flatnonzero(head)
                firsts = docs[heads] if head[0] else np.concatenate([[first], docs[heads]])
                later = docs > firsts[run]
                out.append((docs[later], keys[later]))
                several = np.zeros(len(firsts), dtype=bool)
                several[run[later]] = True
                if first_too:
                    new = several.copy()
                    if not head[0]:
                        new[0] &= not told
                    own = keys[heads] if head[0] else np.concatenate([keys[:1], keys[heads]])
                    out.append((firsts[new], own[new]))
                told = bool(several[-1]) or (told and len(firsts) == 1 and not head[0])
                key, first = keys[-1], int(firsts[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=_OUT)

    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = df.mapInArrow(send, SENT).repartition(width, "deal").sortWithinPartitions("key", "doc_id")
    return sent.select("key", "doc_id", "asks", "marked").mapInArrow(mark, "doc_id bigint, key bigint")


def by_document(rows: DataFrame, name: str) -> DataFrame:
    """The distinct keys of each document as an array column; no longer than its text."""
    return rows.groupBy("doc_id").agg(F.collect_set("key").alias(name))
