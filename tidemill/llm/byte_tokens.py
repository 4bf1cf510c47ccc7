"""Ids of a byte-level vocabulary and of a piece vocabulary, made once for each distinct segment of a slice.

A segment begins where a space follows a visible byte and goes up to the next
such place. Neither kind of vocabulary ever joins bytes over the start of a
segment: the byte-level one cuts a text before a run of spaces, and no entry of
the piece vocabulary holds a space after another sign (both are checked when a
file is read). So the tokens of a text are those of its segments one after
the other. The distinct segments of a slice are strung together, encoded in
one call, and cut apart again by the byte lengths of their tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .text import _buffers, span_hashes

SLICE_BYTES, SLICE_ROWS = 8 << 20, 1 << 14
_SPACE = 0x20
# Lead bytes of visible signs beyond ASCII, by their number of bytes; the Unicode spaces lie under C2, E1, E2 and E3.
_LEADS = {size: np.isin(np.arange(256), lead) for size, lead in {2: [*range(0xC3, 0xE0)], 3: [0xE0, *range(0xE4, 0xF0)], 4: [*range(0xF0, 0xF5)]}.items()}


def byte_alphabet() -> dict[str, int]:
    """The signs by which byte-level vocabularies write bytes: printable bytes stand for themselves, the rest follow from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {chr(b if b in own else next(rest)): b for b in range(256)}


@dataclass
class Entries:
    """The bytes of each id: those of id i are data[begin[i]:begin[i + 1]]."""

    data: np.ndarray
    begin: np.ndarray

    @staticmethod
    def of(entries: list[bytes]) -> Entries:
        return Entries(np.frombuffer(b"".join(entries), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in entries])]).astype(np.int64))

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.begin)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ``ids`` one after the other."""
        return self.data[runs(self.begin[ids], self.lengths[ids])]


def runs(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin, begin + 1, … of each run, one run after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(begins - (ends - counts), counts) + np.arange(total)


@dataclass
class Segments:
    """Some texts of a column, cut into segments; text i has the segments bounds[i] to bounds[i + 1]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the distinct segments, and for each segment which of them it is."""
        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        _, first, which = np.unique(span_hashes(self.data, self.starts, self.ends), return_index=True, return_inverse=True)
        return first, which


def segments(column: pa.Array | pa.ChunkedArray, before: bytes = b"", slice_bytes: int = SLICE_BYTES) -> Iterator[Segments]:
    """The texts of a column, each behind the bytes ``before`` (a null or empty text has none of them), in slices of bounded size."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    data, places = _buffers(column)
    lead = np.frombuffer(before, dtype=np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(places, places[i] + slice_bytes, "right")) - 1), i + SLICE_ROWS)
        own, offsets = data[places[i] : places[j]], places[i : j + 1] - places[i]
        if len(lead):
            held = np.diff(offsets) > 0
            at = np.repeat(offsets[:-1][held], len(lead))
            own = np.insert(own, at, np.tile(lead, int(held.sum())))
            offsets = offsets + np.concatenate([[0], np.cumsum(held * len(lead))])
        yield _cut(i, own, offsets)
        i = j


def _visible(data: np.ndarray) -> np.ndarray:
    """Bytes that end a visible sign."""
    out = (data > _SPACE) & (data < 0x7F)
    for size, leads in _LEADS.items():
        out[size - 1 :] |= (data[size - 1 :] >= 0x80) & leads[data[: len(data) - size + 1]]
    return out


def _cut(first: int, data: np.ndarray, offsets: np.ndarray) -> Segments:
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = (data[1:] == _SPACE) & _visible(data)[:-1]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(cut)
    return Segments(first, data, offsets, starts, np.append(starts[1:], len(data)) if len(starts) else starts, np.searchsorted(starts, offsets))


def _strung(part: Segments, at: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the segments at the places ``at``, where each begins, its size, and whether it can be encoded in one string with others."""
    sizes = part.ends[at] - part.starts[at]
    begins = np.cumsum(sizes) - sizes
    data = part.data[runs(part.starts[at], sizes)]
    joint = (data[begins] == _SPACE) & _visible(data)[begins + sizes - 1] if len(sizes) else np.zeros(0, dtype=bool)
    return data.tobytes(), begins, sizes, joint


@dataclass
class Coded:
    """The ids of each distinct segment: those of segment k are ids[begin[k]:begin[k + 1]]."""

    ids: np.ndarray
    begin: np.ndarray


def _apart(ids: np.ndarray, entries: Entries, sizes: np.ndarray) -> Coded:
    """Cut the ids of segments strung together where each segment's bytes end."""
    ends = np.cumsum(entries.lengths[ids])
    upto = np.cumsum(sizes)
    begin = np.concatenate([[0], np.searchsorted(ends, upto) + 1]).astype(np.int64)
    if len(upto) and not np.array_equal(ends[begin[1:] - 1], upto):
        raise AssertionError("a token reaches over the start of a segment")
    return Coded(ids, begin)


class ByteLevel:
    """A byte-level BPE file of the ``tokenizers`` library, run by the same ranks in ``tiktoken``."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        byte = byte_alphabet()
        vocabulary = {name: i for name, i in model["vocab"].items()}
        added = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        ranks = [vocabulary["".join(x)] for x in merges]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        if model.get("type") != "BPE" or not plain or ranks != sorted(ranks) or any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens") or []):
            raise ValueError(f"{path}: not a byte-level BPE vocabulary with ranks in the order of its ids")
        table = {bytes(byte[c] for c in name): i for name, i in vocabulary.items() if name not in added}
        # Fixed value: the public pattern by which this kind of vocabulary cuts a text.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.code = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        size = max([*table.values(), *added.values()]) + 1
        entries = [b""] * size
        for name, i in table.items():
            entries[i] = name
        for name, i in added.items():
            entries[i] = name.encode()
        self.entries, self.added = Entries.of(entries), added
        self.inside = re.compile("|".join(re.escape(x) for x in sorted(added, key=len, reverse=True))) if added else None

    def encode(self, raw: bytes, added: bool = False) -> np.ndarray:
        """Ids of one text; ``added`` tokens in it keep their own id, else they are plain text."""
        text = raw.decode()
        if not added or self.inside is None:
            return self.code.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32)
        out, at = [], 0
        for m in self.inside.finditer(text):
            out += [self.encode(text[at : m.start()].encode()), np.array([self.added[m.group()]], dtype=np.uint32)]
            at = m.end()
        return np.concatenate([*out, self.encode(text[at:].encode())])

    def distinct(self, part: Segments, at: np.ndarray) -> Coded:
        """Ids of the segments at the places ``at``."""
        raw, begins, sizes, joint = _strung(part, at)
        order = np.concatenate([np.flatnonzero(joint), np.flatnonzero(~joint)])
        n = int(joint.sum())
        flat = b"".join([raw[b : b + s] for b, s in zip(begins[order[:n]].tolist(), sizes[order[:n]].tolist())])
        parts = [self.encode(flat)] + [self.encode(raw[begins[k] : begins[k] + sizes[k]]) for k in order[n:].tolist()]
        return _reordered(_apart(np.concatenate(parts).astype(np.int64), self.entries, sizes[order]), order)


def _reordered(got: Coded, order: np.ndarray) -> Coded:
    """Coded segments given in ``order``, put back to their places."""
    counts = np.diff(got.begin)
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    return Coded(got.ids[runs(got.begin[:-1][back], counts[back])], np.concatenate([[0], np.cumsum(counts[back])]).astype(np.int64))


class Pieces:
    """A sentencepiece file whose entries hold a space only in front; it sets a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.code = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.code.id_to_piece(i) for i in range(self.code.get_piece_size())]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError(f"{path}: an entry holds a space after another sign")
        entries = []
        for i, name in enumerate(names):
            entries.append(bytes([int(name[3:5], 16)]) if self.code.is_byte(i) else name.replace("▁", " ").encode())
        self.entries = Entries.of(entries)

    def _ids(self, raw: bytes) -> list[int]:
        """Ids of bytes that begin with a space."""
        if raw.strip(b" "):
            return self.code.encode(raw[1:].decode())
        return self.code.encode("a" + raw.decode())[len(self.code.encode("a")) :]

    def distinct(self, part: Segments, at: np.ndarray) -> tuple[Coded, np.ndarray]:
        """Ids of the segments at the places ``at``, all of which begin with a space, and whether their bytes are the segment's."""
        raw, begins, sizes, joint = _strung(part, at)
        mark = "▁".encode()
        place = raw.find(mark)
        while place >= 0:  # this sign comes back as a space
            joint[np.searchsorted(begins, place, "right") - 1] = False
            place = raw.find(mark, place + 1)
        order = np.concatenate([np.flatnonzero(joint), np.flatnonzero(~joint)])
        n = int(joint.sum())
        own = [raw[b : b + s] for b, s in zip(begins[order].tolist(), sizes[order].tolist())]
        flat = b"".join(own[:n])
        ids = np.array(self._ids(flat) if flat else [], dtype=np.int64)
        if self.entries.joined(ids).tobytes() != flat:
            raise AssertionError("ids of texts without the sign for a space do not give the text back")
        first = _apart(ids, self.entries, sizes[order[:n]])
        single = [np.array(self._ids(x), dtype=np.int64) for x in own[n:]]
        same = np.ones(len(sizes), dtype=bool)
        same[order[n:]] = [self.entries.joined(x).tobytes() == y for x, y in zip(single, own[n:])]
        begin = np.concatenate([first.begin, first.begin[-1] + np.cumsum([len(x) for x in single], dtype=np.int64)])
        return _reordered(Coded(np.concatenate([ids, *single]), begin), order), same


@lru_cache(maxsize=2)
def byte_level(path: str) -> ByteLevel:
    """One in each Python worker."""
    return ByteLevel(path)


@lru_cache(maxsize=2)
def piece_level(path: str) -> Pieces:
    return Pieces(path)


def byte_ids(column: pa.Array, path: str, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, offsets) for slices of a text column, as the plain tokenizer gives them; null has none."""
    code = byte_level(path)
    for part in segments(column, slice_bytes=slice_bytes):
        inside = [name.encode() for name in code.added]
        raw = part.data.tobytes()
        if any(name in raw for name in inside):  # an added token may hold a space, so these slices are encoded text by text
            own = [code.encode(raw[b:e], added=True) for b, e in zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist())]
            yield np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
            continue
        at, which = part.distinct()
        got = code.distinct(part, at)
        counts = np.diff(got.begin)[which]
        yield got.ids[runs(got.begin[:-1][which], counts)], np.concatenate([[0], np.cumsum(counts)])[part.bounds].astype(np.int64)
