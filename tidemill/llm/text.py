"""Array kernels over whole texts, shared by the operators of this package.

A word is a run of bytes other than space and U+0009 to U+000D. Texts are
taken from Arrow buffers as UTF-8 bytes and cut into slices of bounded size, so
memory follows the slice and the longest text, not the batch. Null is an empty
text. Words and word sequences are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # fixed values: a public 64-bit finaliser
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


@dataclass
class Texts:
    """Some texts of a batch with their words; all positions count within ``data``."""

    first: int  # place of the first text in its batch
    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # text i is data[offsets[i]:offsets[i + 1]]
    starts: np.ndarray  # of words
    ends: np.ndarray
    bounds: np.ndarray  # words of text i are bounds[i] to bounds[i + 1]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null has no bytes."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), places


def texts(column: pa.Array | pa.ChunkedArray, lower: bool = False, slice_bytes: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of a column in slices; ``lower`` turns A-Z into a-z."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    data, places = _buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(places, places[i] + slice_bytes, "right")) - 1)
        own = data[places[i] : places[j]]
        yield cut(i, _LOWER[own] if lower else own, places[i : j + 1] - places[i])
        i = j


def cut(first: int, data: np.ndarray, offsets: np.ndarray) -> Texts:
    """Find the words of concatenated texts; none reaches over the end of its text."""
    solid = ~_BLANK[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begin[edges] = solid[edges]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    end[last] = solid[last]
    starts = np.flatnonzero(begin)
    return Texts(first, data, offsets, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded.data, strides=(1,))
    rest = ends - starts
    out = mix(rest.astype(np.uint64) * _STEP)
    at, live = starts, None
    while True:
        x = eight[at] & _KEEP[np.minimum(rest, 8)]
        if live is None:
            out = mix(out ^ x)
        else:
            out[live] = mix(out[live] ^ x)
        more = np.flatnonzero(rest > 8)
        if not len(more):
            return out
        live = more if live is None else live[more]
        at, rest = at[more] + 8, rest[more] - 8


def word_hashes(part: Texts) -> np.ndarray:
    return span_hashes(part.data, part.starts, part.ends) if len(part.starts) else np.zeros(0, np.uint64)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; those over the end of a text are the caller's to leave out."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, size):
        out *= _STEP
        out += words[k : n + k]
    return mix(out)


def shingle_sets(part: Texts, size: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words than ``size``, the whole sequence is one; no word, no shingle."""
    words = word_hashes(part)
    grams = gram_hashes(words, size)
    for b, e in zip(part.bounds[:-1].tolist(), part.bounds[1:].tolist()):
        if e - b >= size:
            own = np.sort(grams[b : e - size + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own
        elif e > b:
            yield mix(gram_hashes(words[b:e], e - b) + np.uint64(e - b))
        else:
            yield np.zeros(0, np.uint64)


def slice_column(batch: pa.RecordBatch, name: str, part: Texts) -> pa.Array:
    """A column of the rows that ``part`` covers."""
    return batch.column(name).slice(part.first, len(part))


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from concatenated values."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
