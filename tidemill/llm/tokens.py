"""Token ids of whole texts by a public tokenizer file.

The vocabulary is read where the task runs, from a path that is a parameter.
Texts are cut at white space, which this kind of tokenizer drops and never
joins over. Of a slice of texts only the distinct pieces are encoded, through
a bounded cache, and the ids of all its texts are then gathered by arrays. A
text that holds an added token of the vocabulary, such as <|endoftext|>, is
given whole to the tokenizer, as are all texts with a vocabulary of another kind.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .text import Texts, texts, word_hashes

CACHED_WORDS = 500_000  # under 120 MB a worker
SLICE_BYTES = 6 << 20
_PARTS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")  # letters, a digit, other signs but the apostrophe
_LETTER, _SIGN = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SIGN[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27]] = True


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of pieces without white space, as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        parts = [x["type"] for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        added = spec.get("added_tokens") or []
        self.added = [x["content"].encode() for x in added if x["content"]]
        # tokens that are matched after normalization cannot be looked for in the raw bytes
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and parts == ["Split", "ByteLevel"] and not any(x.get("normalized") for x in added)
        # the byte alphabet of byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256 on
        own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        rest = iter(range(256, 512))
        self.alphabet = {b: b if b in own else next(rest) for b in range(256)}
        self.pieces: dict[bytes, bytes] = {}

    def plain(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def part(self, part: str) -> bytes:
        ids = [t.id for t in self.whole.model.tokenize(part.encode().decode("latin-1").translate(self.alphabet))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def piece(self, raw: bytes) -> bytes:
        found = self.pieces.get(raw)
        if found is None:
            if len(self.pieces) >= CACHED_WORDS:
                self.pieces.clear()
            word = raw.decode()
            low = word.lower()
            parts = _PARTS.findall(low)
            if sum(map(len, parts)) == len(low):
                found = b"".join(map(self.part, parts))
            else:
                found = self.plain(word)
            self.pieces[raw] = found
        return found


def _holding(raw: bytes, offsets: np.ndarray, added: list[bytes]) -> list[int]:
    """The texts of a slice that hold one of the ``added`` tokens within themselves."""
    found = set()
    for token in added:
        at = raw.find(token)
        while at >= 0:
            i = int(np.searchsorted(offsets, at, "right")) - 1
            inside = at + len(token) <= offsets[i + 1]
            if inside:
                found.add(i)
            at = raw.find(token, int(offsets[i + 1]) if inside else at + 1)
    return sorted(found)


def _finer(part: Texts) -> None:
    """Cut words where a letter meets an ASCII sign other than the apostrophe: pieces that this kind of vocabulary never joins."""
    data, before = part.data, np.concatenate([[np.uint8(0)], part.data[:-1]])
    letter = _LETTER[data] | ((before == 0xC3) & (data >= 0x80) & (data != 0x97) & (data != 0xB7))
    lead = (data == 0xC3) & np.concatenate([letter[1:], [False]])
    sign = _SIGN[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[1:-1] = (letter[:-1] & sign[1:]) | (sign[:-1] & (letter | lead)[1:])
    cut[part.offsets] = False
    places = np.flatnonzero(cut)
    starts, ends = np.concatenate([part.starts, places]), np.concatenate([part.ends, places])
    starts.sort()
    ends.sort()
    part.starts, part.ends, part.bounds = starts, ends, np.searchsorted(starts, part.offsets)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder in each Python worker."""
    return Encoder(path)


def encoded(column: pa.Array, path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, offsets) for slices of a text column: text i of a slice has ids[offsets[i]:offsets[i + 1]]; null has none."""
    code = encoder(path)
    for part in texts(column, slice_bytes=SLICE_BYTES):
        raw = part.data.tobytes()
        if code.by_word and len(part.data):
            _finer(part)
        if not code.by_word:
            own = [code.plain(raw[b:e].decode()) for b, e in zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist())]
            yield np.frombuffer(b"".join(own), dtype="<u4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in own])]).astype(np.int64)
            continue
        _, first, which = np.unique(word_hashes(part), return_index=True, return_inverse=True)
        found = [code.piece(raw[b:e]) for b, e in zip(part.starts[first].tolist(), part.ends[first].tolist())]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        begins = np.cumsum(sizes) - sizes
        count = sizes[which]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(begins[which] - (ends - count), count) + np.arange(total)
        ids, places = np.frombuffer(b"".join(found), dtype="<u4")[at], np.concatenate([[0], ends])[part.bounds]
        held = _holding(raw, part.offsets, code.added)
        if held:
            sizes, chunks, done = np.diff(places), [], 0
            for i in held:
                own = np.frombuffer(code.plain(raw[part.offsets[i] : part.offsets[i + 1]].decode()), dtype="<u4")
                chunks += [ids[done : places[i]], own]
                sizes[i], done = len(own), places[i + 1]
            ids, places = np.concatenate([*chunks, ids[done:]]), np.concatenate([[0], np.cumsum(sizes)])
        yield ids, places
