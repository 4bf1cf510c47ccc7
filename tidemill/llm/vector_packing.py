"""Packing examples into sequences under several limits at once: tokens, segments and tokens that bear loss.

An example asks for a vector: its tokens, one segment, and its loss-bearing
tokens (those behind its prompt). Sequences are filled one after the other by
the dot-product heuristic: of all examples that still fit, the one goes in
whose vector has the largest product with the room that is left, each dimension
weighed by how scarce it is. Where nothing fits, the largest example is cut to
fill the gap; the rest of it waits for another sequence.

Examples are encoded and packed where they are read, from a buffer of bounded
size; nothing is shuffled but the last open sequence of each task. Those are
dealt to ever fewer tasks and filled up in the same way, and what the last task
cannot fill is cut into sequences whose lengths are powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_tokens import byte_ids
from .tables import keep
from .tokens import vocabulary

TOKENS, SEGMENTS, END = 2048, 128, 1
BUFFER_IDS = 2 << 20
TASK_ROWS = 20_000  # open pieces that one task packs in a later round
_ROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("loss_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
     ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("open", pa.bool_())]
)
_KINDS = "doc_id bigint, start bigint, length bigint, loss_tokens bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary, open boolean"


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most. Without ``loss`` any of its tokens may bear loss."""

    tokens: int = TOKENS
    segments: int = SEGMENTS
    loss: int | None = None

    def __post_init__(self) -> None:
        if self.tokens < 1 or self.segments < 1 or (self.loss is not None and self.loss < 1):
            raise ValueError("a sequence must have room for a token")

    @property
    def most_loss(self) -> int:
        return self.tokens if self.loss is None else min(self.loss, self.tokens)


@dataclass
class Piece:
    """Consecutive ids of one example, of which the first ``free`` bear no loss."""

    doc: int | None
    start: int
    ids: np.ndarray
    free: int
    whole: int  # tokens of the example

    def __len__(self) -> int:
        return len(self.ids)

    @property
    def loss(self) -> int:
        return len(self.ids) - self.free

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:at], min(self.free, at), self.whole), Piece(self.doc, self.start + at, self.ids[at:], max(0, self.free - at), self.whole)


class Pool:
    """Pieces by what they ask for; pieces that ask for the same are one kind."""

    def __init__(self, limits: Limits):
        self.limits, self.kinds, self.known = limits, 0, {}
        self.tokens, self.loss, self.count = (np.zeros(64, dtype=np.int64) for _ in range(3))
        self.held: list[list[Piece]] = []
        self.ids = self.pieces = self.losses = 0

    def add(self, piece: Piece) -> None:
        key = (len(piece), piece.loss)
        k = self.known.get(key)
        if k is None:
            if self.kinds == len(self.tokens):
                self._shrink()
            k = self.known[key] = self.kinds
            self.tokens[k], self.loss[k] = key
            self.held.append([])
            self.kinds += 1
        self.held[k].append(piece)
        self.count[k] += 1
        self._sum(piece, 1)

    def _shrink(self) -> None:
        """Forget kinds without pieces; make room if most are in use."""
        live = np.flatnonzero(self.count[: self.kinds])
        size = max(64, 2 * len(live))
        self.tokens, self.loss, self.count = (np.concatenate([x[live], np.zeros(size - len(live), dtype=np.int64)]) for x in (self.tokens, self.loss, self.count))
        self.held, self.kinds = [self.held[k] for k in live.tolist()], len(live)
        self.known = {(int(self.tokens[k]), int(self.loss[k])): k for k in range(self.kinds)}

    def _sum(self, piece: Piece, sign: int) -> None:
        self.ids += sign * len(piece)
        self.losses += sign * piece.loss
        self.pieces += sign

    def _take(self, k: int) -> Piece:
        piece = self.held[k].pop()
        self.count[k] -= 1
        self._sum(piece, -1)
        return piece

    def best(self, tokens: int, segments: int, loss: int) -> Piece | None:
        """The piece that fits the room left with the largest weighed dot product."""
        if segments < 1:
            return None
        n, limits = self.kinds, self.limits
        asks, bears = self.tokens[:n], self.loss[:n]
        fits = (self.count[:n] > 0) & (asks <= tokens) & (bears <= loss)
        # a dimension weighs what all waiting pieces ask of it
        weight = np.array([self.ids / limits.tokens, self.pieces / limits.segments, self.losses / limits.most_loss])
        room = weight / weight.sum() * [tokens / limits.tokens, segments / limits.segments, loss / limits.most_loss]
        score = np.where(fits, asks * (room[0] / limits.tokens) + bears * (room[2] / limits.most_loss) + room[1] / limits.segments, -1.0)
        k = int(np.argmax(score))
        return self._take(k) if score[k] >= 0 else None

    def slice(self, tokens: int, segments: int, loss: int) -> Piece | None:
        """A piece cut off from the front of a larger one, as long as the room allows."""
        if segments < 1 or tokens < 1:
            return None
        n = self.kinds
        length = np.where(self.count[:n] > 0, np.minimum(self.tokens[:n], np.minimum(tokens, self.tokens[:n] - self.loss[:n] + loss)), 0)
        longest = np.flatnonzero(length == length.max())
        exact = self.tokens[longest] == length.max()  # without a cut, if there is one
        k = int(longest[np.argmax(np.where(exact, self.limits.tokens + 1, self.tokens[longest]))])
        if length[k] < 1:
            return None
        piece = self._take(k)
        if length[k] == len(piece):
            return piece
        front, rest = piece.cut(int(length[k]))
        self.add(rest)
        return front


def sequence(pool: Pool, cut: bool) -> tuple[list[Piece], bool]:
    """The next sequence, and whether it has room left only because the pool is empty."""
    limits = pool.limits
    tokens, segments, loss, out = limits.tokens, limits.segments, limits.most_loss, []
    while tokens and pool.pieces:
        # the last segment has to fill the sequence
        piece = pool.best(tokens, segments, loss) if segments > 1 or not cut else None
        piece = piece or (pool.slice(tokens, segments, loss) if cut else None)
        if piece is None:
            break
        out.append(piece)
        tokens, segments, loss = tokens - len(piece), segments - 1, loss - piece.loss
    return out, tokens > 0 and not pool.pieces


def shorten(pool: Pool, own: list[Piece]) -> list[Piece]:
    """The front of a sequence up to a power of two; what lies behind it goes back to the pool."""
    size = sum(map(len, own))
    over = size - (1 << (size.bit_length() - 1))
    while over:
        last = own.pop()
        if len(last) > over:
            front, last = last.cut(len(last) - over)
            own.append(front)
        pool.add(last)
        over -= len(last)
    return own


def parts(doc: int | None, ids: np.ndarray, free: int, limits: Limits) -> Iterator[Piece]:
    """An example in pieces that fit an empty sequence."""
    rest = Piece(doc, 0, ids, free, len(ids))
    while len(rest):
        at = min(len(rest), limits.tokens, rest.free + limits.most_loss)
        piece, rest = rest.cut(at)
        yield piece


class Packer:
    """One task's packing: examples in, rows out."""

    def __init__(self, limits: Limits, cut: bool, keep_ids: bool, base: int):
        self.limits, self.cut, self.keep_ids, self.base = limits, cut, keep_ids, base
        self.pool, self.made, self.rows = Pool(limits), 0, []

    def emit(self, own: list[Piece], open_: bool = False) -> None:
        at = 0
        for p in own:
            raw = p.ids.astype("<u4").tobytes()
            self.rows.append((p.doc, p.start, len(p), p.loss, zlib.crc32(raw), p.whole, None if open_ else self.base + self.made, at, raw if open_ or self.keep_ids else None, open_))
            at += len(p)
        self.made += not open_

    def add(self, piece: Piece) -> None:
        if len(piece) == self.limits.tokens:
            self.emit([piece])
        else:
            piece.ids = piece.ids.copy()  # not a view that holds the whole example
            self.pool.add(piece)

    def drain(self, upto: int) -> None:
        """Make sequences until no more than ``upto`` ids wait."""
        while self.pool.ids > upto:
            own, short = sequence(self.pool, self.cut)
            if self.cut and not short and sum(map(len, own)) < self.limits.tokens:
                own = shorten(self.pool, own)
            self.emit(own)

    def finish(self, last: bool) -> None:
        """Pack all that waits; the sequence that the pool could not fill stays open, or is cut to powers of two."""
        while self.pool.pieces:
            own, short = sequence(self.pool, self.cut)
            if self.cut and sum(map(len, own)) < self.limits.tokens and (last or not short):
                own = shorten(self.pool, own)
            self.emit(own, open_=short and not last)

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            for i in range(0, len(self.rows), 5_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows[i : i + 5_000]), _ROW)], schema=_ROW)
            self.rows = []


def _base(level: int) -> int:
    from pyspark import TaskContext

    return (level << 56) | (TaskContext.get().partitionId() << 32)


def _first(docs: DataFrame, path: str, prompt: str | None, limits: Limits, end: int, cut: bool, keep_ids: bool, buffer_ids: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, cut, keep_ids, _base(0))
        last = np.array([end], dtype="<u4")
        for batch in batches:
            names = iter(batch.column("doc_id").to_pylist())
            bodies = (ids[b:e] for ids, offsets in byte_ids(batch.column("text"), path) for b, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()))
            fronts = (ids[b:e] for ids, offsets in byte_ids(batch.column("prompt"), path) for b, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())) if prompt else None
            for doc, body in zip(names, bodies, strict=True):
                front = next(fronts) if fronts is not None else body[:0]
                for piece in parts(doc, np.concatenate([front, body, last]), len(front), limits):
                    packer.add(piece)
                if packer.pool.ids >= buffer_ids:
                    packer.drain(buffer_ids // 4)
                yield from packer.batches(5_000)
        packer.finish(False)
        yield from packer.batches(1)

    names = ["doc_id", "text", *([F.col(prompt).alias("prompt")] if prompt else [])]
    return docs.select(*names).mapInArrow(run, _KINDS)


def _again(open_: DataFrame, tasks: int, level: int, limits: Limits, cut: bool, keep_ids: bool, buffer_ids: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, cut, keep_ids, _base(level))
        for batch in batches:
            for doc, start, length, loss, _, whole, _, _, raw, _ in zip(*(batch.column(f.name).to_pylist() for f in _ROW)):
                packer.add(Piece(doc, start, np.frombuffer(raw, dtype="<u4"), length - loss, whole))
            if packer.pool.ids >= buffer_ids:
                packer.drain(buffer_ids // 4)
            yield from packer.batches(5_000)
        packer.finish(tasks == 1)
        yield from packer.batches(1)

    return open_.repartition(tasks).mapInArrow(run, _KINDS)


def pack(
    docs: DataFrame,
    path: str | None = None,
    prompt: str | None = None,
    limits: Limits = Limits(),
    end: int = END,
    cut: bool = True,
    keep_ids: bool = False,
    buffer_ids: int = BUFFER_IDS,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Pieces of all examples placed in sequences that keep the ``limits``.

    ``docs`` has doc_id and text, and a ``prompt`` column if one is named; other
    columns are left out. An example is the ids of its prompt, those of its text
    and the ``end`` id; all but the prompt's bear loss. ``path`` is a byte-level
    tokenizer file. With ``cut`` examples are cut to fill sequences, and a
    sequence that is not full has a power of two of ids; without it only
    examples that no sequence can hold are cut, and sequences may stay underfull.

    Returns doc_id, start (ids of the example before the piece), length,
    loss_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit
    numbers), doc_tokens (of the example), sequence_id, offset (its place
    there, gapless from 0), and with ``keep_ids`` its ids. A null or empty text
    is the end id alone; rows that repeat a doc_id, or have none, are packed
    each on its own. No rows, no sequences.
    """
    path = path or vocabulary("byte_bpe_50k.json")
    done = keep(_first(docs, path, prompt, limits, end, cut, keep_ids, buffer_ids), "packed")
    names = [f.name for f in _ROW if f.name not in ("open", *(() if keep_ids else ("ids",)))]
    placed, level, tasks = done.where("NOT open").select(*names), 1, None
    while True:
        rest = done.where("open")
        count = rest.count()
        if not count:
            return placed
        # ever fewer tasks, however many pieces their open sequences hold
        tasks = max(1, count // task_rows if tasks is None else min(count // task_rows, tasks // 2))
        done = keep(_again(rest, tasks, level, limits, cut, keep_ids, buffer_ids), "packed")
        placed, level = placed.unionByName(done.where("NOT open").select(*names)), level + 1
