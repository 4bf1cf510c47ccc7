"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of each ``window - anchor + 1`` consecutive word
sequences of length ``anchor`` the one with the smallest hash. A repeat of
``window`` words or more holds the same anchor in every document that has it,
so joining documents on anchors misses none. A seed that several documents
share is extended both ways: the windows around it, from the one it ends to
the one it begins, are compared across the documents. Windows that match run
together to maximal repeats, and the words they cover are removed from every
document but the one with the smallest doc_id.

Two shuffles of hashes, both combined before they are sent (``repeats``), and
one of the texts, which serves both reads of them. No pairs of documents are
formed: a passage that m documents share costs m rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .text import Texts, gram_hashes, signed, texts, word_hashes

WINDOW, ANCHOR = 13, 5


def _windows(part: Texts, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the starts of whole windows, and the text of each start."""
    words = word_hashes(part)
    own = np.repeat(np.arange(len(part)), part.counts)
    starts = np.arange(len(words))
    whole = starts + window <= part.bounds[1:][own]
    return words, starts[whole], own[whole]


def _anchors(words: np.ndarray, starts: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word sequences, and of each window the place of its smallest, the last among equals."""
    grams = gram_hashes(words, anchor)
    least, place = grams[starts], starts
    for k in range(1, window - anchor + 1):
        other = grams[starts + k]
        better = other <= least
        least, place = np.where(better, other, least), np.where(better, starts + k, place)
    return grams, place


def _known(batch: pa.RecordBatch, part: Texts) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids of a slice (0 where null) and which are not null."""
    ids = batch.column("doc_id").slice(part.first, len(part)).cast(pa.int64())
    return ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)


def _emit_anchors(window: int, anchor: int) -> repeats.Emitter:
    def emit(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in texts(batch.column("text")):
            ids, valid = _known(batch, part)
            words, starts, own = _windows(part, window)
            if len(starts):
                grams, place = _anchors(words, starts, window, anchor)
                keep = np.concatenate([[True], place[1:] != place[:-1]]) & valid[own]
                yield grams[place[keep]], ids[own[keep]]

    return emit


def _emit_windows(window: int, anchor: int) -> repeats.Emitter:
    def emit(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        batch = batch.filter(batch.column("seeds").is_valid())
        seeds = batch.column("seeds")
        for part in texts(batch.column("text")):
            ids, _ = _known(batch, part)
            words, starts, own = _windows(part, window)
            if not len(starts):
                continue
            grams, place = _anchors(words, starts, window, anchor)
            at = signed(grams[place])
            held = seeds.slice(part.first, len(part))
            flat, counts = held.flatten().to_numpy(), held.value_lengths().to_numpy()
            # a window is extended when its own anchor is a seed of its own document
            pairs = np.unique(np.stack([np.repeat(np.arange(len(part)), counts), flat], 1), axis=0)
            seeded = _among(own, at, pairs)
            yield gram_hashes(words, window)[starts[seeded]], ids[own[seeded]]

    return emit


def _among(own: np.ndarray, keys: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Which (text, key) are among the (text, key) pairs, sorted by both."""
    if not len(pairs):
        return np.zeros(len(own), dtype=bool)
    kind = np.dtype([("t", np.int64), ("k", np.int64)])
    have = np.ascontiguousarray(pairs).view(kind).ravel()
    want = np.empty(len(own), dtype=kind)
    want["t"], want["k"] = own, keys
    return np.isin(_one(want), _one(have))


def _one(pairs: np.ndarray) -> np.ndarray:
    """One number of a (text, key) pair, unlike for unlike pairs but for a 64-bit hash."""
    return pairs["k"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (pairs["t"].astype(np.uint64) * np.uint64(0xC4CEB9FE1A85EC53))


def _covered(part: Texts, i: int, grams: np.ndarray, gone: np.ndarray, window: int) -> np.ndarray:
    """Which words of text ``i`` lie in a window whose hash is among ``gone``."""
    b, n = part.bounds[i], part.counts[i]
    step = np.zeros(n + 1, dtype=np.int64)
    hits = np.flatnonzero(np.isin(signed(grams[b : b + n - window + 1]), gone))
    np.add.at(step, hits, 1)
    np.add.at(step, hits + window, -1)
    return np.cumsum(step[:-1]) > 0


def repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, key): hashes of the windows of a document that also start in a document with a smaller doc_id.

    ``docs`` has doc_id and text, and what else the caller joins with the result.
    """
    anchors = repeats.shared_keys(docs.select("doc_id", "text"), _emit_anchors(window, anchor), first_too=True)
    # a left join of all columns, as the callers do: the texts are then shuffled once for both
    seeded = docs.join(repeats.by_document(anchors, "seeds"), "doc_id", "left")
    return repeats.shared_keys(seeded, _emit_windows(window, anchor), first_too=False)


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Each document without the words that repeat an earlier one.

    ``docs`` has doc_id and text; other columns, whatever their names, are
    left out. Returns doc_id, n_words, n_removed, kept (the words left, joined
    by one space; null text: empty), spans (start and end of each removed run
    of words, in words). Windows of ``window`` consecutive words are judged on
    the input. A null or empty text has no words and stays. Fewer words than
    ``window`` are never removed. A row without doc_id is left whole and is no
    earlier document. Rows with the same doc_id are not earlier than each
    other and lose the same windows. Words are compared by 64-bit hashes of
    whole windows.
    """
    read = docs.select("doc_id", "text")
    held = read.join(repeats.by_document(repeated_windows(read, window, anchor), "gone"), "doc_id", "left")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
         ("spans", pa.list_(pa.list_(pa.int32())))]
    )

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts(batch.column("text")):
                counts, spans, kept, removed = part.counts, [], [], []
                marks = batch.column("gone").slice(part.first, len(part))
                raw = part.data.tobytes()
                grams = gram_hashes(word_hashes(part), window) if marks.null_count < len(marks) else None
                for i in range(len(part)):
                    words = raw[part.offsets[i] : part.offsets[i + 1]].split()
                    if marks[i].is_valid and counts[i] >= window:
                        out = _covered(part, i, grams, marks[i].values.to_numpy(), window)
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]])))
                        spans.append(edge.reshape(-1, 2).tolist())
                        removed.append(int(out.sum()))
                        words = [words[k] for k in np.flatnonzero(~out).tolist()]
                    else:
                        spans.append([])
                        removed.append(0)
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(part.first, len(part)).cast(pa.int64()), pa.array(counts, pa.int64()),
                     pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, schema.field("spans").type)],
                    schema=schema,
                )

    return held.mapInArrow(cut_out, "doc_id bigint, n_words bigint, n_removed bigint, kept string, spans array<array<int>>")


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs``, all rows and columns, with the repeated words cut out of text.

    What is left of a text keeps its own white space, with one space where
    words were cut out; a text that loses nothing stays as it is, a text that
    loses all becomes empty. n_chars, if there, is counted anew. As to nulls and
    repeated rows see :func:`remove_repeats`.
    """
    rest = F.struct(*[c for c in docs.columns if c != "text"]).alias("row")
    read = docs.select("doc_id", "text", rest)
    held = read.join(repeats.by_document(repeated_windows(read, window, anchor), "gone"), "doc_id", "left")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = batch.column("text").to_pylist()
            for part in texts(batch.column("text")):
                marks = batch.column("gone").slice(part.first, len(part))
                if marks.null_count == len(marks):
                    continue
                raw, grams = part.data.tobytes(), gram_hashes(word_hashes(part), window)
                for i in range(len(part)):
                    if marks[i].is_valid and part.counts[i] >= window:
                        stay = ~_covered(part, i, grams, marks[i].values.to_numpy(), window)
                        runs = np.flatnonzero(np.diff(np.concatenate([[0], stay.view(np.int8), [0]]))).reshape(-1, 2) + part.bounds[i]
                        left[part.first + i] = b" ".join(raw[part.starts[b] : part.ends[e - 1]] for b, e in runs.tolist()).decode()
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(left, pa.string())], names=["row", "left"])

    row = read.select("row").schema.simpleString()[len("struct<row:") : -1]
    cut = held.select("text", "gone", "row").mapInArrow(cut_out, f"row {row}, left string")
    new = {"text": F.col("left"), "n_chars": F.length("left").cast("bigint")}
    return cut.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def digest(result: DataFrame) -> DataFrame:
    """The columns of the query: counts and the hash of what is kept."""
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


__all__ = ["digest", "remove_repeats", "repeated_windows", "without_repeats"]
