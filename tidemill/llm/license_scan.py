"""License scans: MinHash bands over overlapping text windows, then exact containment.

A template is a license notice, header or whole text. Templates of about one length are a class, and
its windows are half as long again and overlap by the longest template, so each
notice in a text lies whole in a window of which it makes up nearly half. With
that similarity s, the window and the template share a band of ROWS MinHash values in BANDS
bands with a probability of 1 - (1 - s ** ROWS) ** BANDS; ``guarantee`` works it
out, and settings that promise less than PROMISE to a template are refused. Retrieved
pairs are verified by the exact share of the template's shingles that the window holds.

Templates are a parameter of bounded size, sent to the tasks; texts are read
once, whole, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .decontamination import _trimmed
from .text import Texts, gram_hashes, mix, texts, word_hashes

ROWS, BANDS, SHINGLE = 1, 24, 3
CONTAINED = 0.75
PROMISE = 0.999
CLASS_RATIO = 1.25
MAX_CHARS = 4 << 20  # of all templates
_HIT = "doc_id bigint, license string, containment double, first_word bigint, last_word bigint"

# Short notices and headers as they are commonly written; whole texts are in the folder licenses.
NOTICES: dict[str, list[str]] = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "GPL-3.0": ["Licensed under the GNU General Public License, Version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": ["All rights reserved."],
}
_HEADER = "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
for _license, _what, _name, _version in (("GPL-2.0", "program", "", "2"), ("LGPL-2.1", "library", "Lesser", "2.1"), ("LGPL-3.0", "library", "Lesser", "3"), ("LGPL-3.0", "program", "Lesser", "3"), ("AGPL-3.0", "program", "Affero", "3")):
    NOTICES.setdefault(_license, []).append(" ".join(_HEADER.format(what=_what, name=_name, version=_version).split()))
for _file in sorted(files(__package__).joinpath("licenses").iterdir(), key=lambda f: f.name):
    if _file.name.endswith(".txt"):
        NOTICES.setdefault(_file.name[:-4], []).append(_file.read_text(encoding="utf-8"))
NOTICES["MIT"].append(NOTICES["MIT"][-1].split("\n\n")[0])  # the grant alone


def guarantee(similarity: float, rows: int = ROWS, bands: int = BANDS) -> float:
    """The probability that a window and a template of this Jaccard similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


@dataclass
class _Class:
    """Templates of about one length."""

    window: int  # words
    step: int
    names: list[str]
    grams: list[np.ndarray]
    bands: np.ndarray  # sorted band values
    owner: np.ndarray  # the template of each


def _seeds(rows: int, bands: int) -> np.ndarray:
    return mix(np.arange(1, rows * bands + 1, dtype=np.uint64))


def _signature(least: list[np.ndarray], rows: int) -> list[np.ndarray]:
    """Band values from the minima of each hash function."""
    out = []
    for b in range(0, len(least), rows):
        value = np.full_like(least[b], np.uint64(b))
        for r in range(rows):
            value = mix(value ^ least[b + r])
        out.append(value)
    return out


def _classes(templates: dict[str, list[str]], rows: int, bands: int, shingle: int) -> list[_Class]:
    names = [(n, t) for n, ts in sorted(templates.items()) for t in ts]
    if sum(len(t) for _, t in names) > MAX_CHARS:
        raise ValueError(f"templates above {MAX_CHARS} characters")
    held, i = [], 0
    for part in texts(pa.array([t for _, t in names], pa.string()), lower=True):
        part = _trimmed(part)
        words = word_hashes(part)
        for b, e in zip(part.bounds[:-1].tolist(), part.bounds[1:].tolist()):
            if e - b >= shingle:
                held.append((e - b, names[i][0], np.unique(gram_hashes(words[b:e], shingle))))
            i += 1
    held.sort(key=lambda x: (x[0], x[1]))
    out, at = [], 0
    while at < len(held):
        own = [x for x in held[at:] if x[0] <= CLASS_RATIO * held[at][0]]
        at += len(own)
        longest = own[-1][0]
        window = -(-3 * longest // 2)
        if guarantee(min(len(g) for _, _, g in own) / (window - shingle + 1), rows, bands) < PROMISE:
            raise ValueError(f"{bands} bands of {rows} find templates of {own[0][0]} words too seldom")
        values = [_signature([np.array([mix(g ^ s).min()]) for s in _seeds(rows, bands)], rows) for _, _, g in own]
        flat, owner = np.array([v[0] for vs in values for v in vs]), np.repeat(np.arange(len(own)), bands)
        order = np.argsort(flat)
        out.append(_Class(window, window - longest + 1, [n for _, n, _ in own], [g for _, _, g in own], flat[order], owner[order]))
    return out


def _windows(part: Texts, cls: _Class, shingle: int, contained: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text, first shingle and end of shingles of each window that has a whole shingle, and enough of them to hold a template."""
    n = np.where(part.counts >= shingle, -(-part.counts // cls.step), 0)
    own = np.repeat(np.arange(len(part)), n)
    starts = part.bounds[:-1][own] + cls.step * (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n))
    last = part.bounds[1:][own] - shingle
    whole = starts <= last
    own, starts, last = own[whole], starts[whole], last[whole]
    ends = np.minimum(starts + cls.window - shingle + 1, last + 1)
    enough = ends - starts >= contained * min(map(len, cls.grams)) - 1e-6
    return own[enough], starts[enough], ends[enough]


def _retrieve(part: Texts, grams: np.ndarray, known: list[_Class], seeds: np.ndarray, rows: int, shingle: int, contained: float) -> Iterator[tuple[_Class, int, int, int, int]]:
    """(class, text, template, first shingle, end) of windows that share a band with a template."""
    windows = [_windows(part, cls, shingle, contained) for cls in known]
    least: list[list[np.ndarray]] = [[] for _ in known]
    for s in seeds:
        h = np.append(mix(grams ^ s), np.uint64(0))  # a place after the last, for windows that end there
        for k, (_, starts, ends) in enumerate(windows):
            least[k].append(np.minimum.reduceat(h, np.stack([starts, ends], 1).ravel())[::2] if len(starts) else np.zeros(0, np.uint64))
    for cls, minima, (own, starts, ends) in zip(known, least, windows):
        found = set()
        for value in _signature(minima, rows):
            lo, hi = np.searchsorted(cls.bands, value, "left"), np.searchsorted(cls.bands, value, "right")
            for w in np.flatnonzero(lo < hi).tolist():
                found.update((w, int(k)) for k in cls.owner[lo[w] : hi[w]])
        for w, k in sorted(found):
            yield cls, int(own[w]), k, int(starts[w]), int(ends[w])


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, contained: float = CONTAINED, rows: int = ROWS, bands: int = BANDS, shingle: int = SHINGLE) -> DataFrame:
    """Licenses that documents hold: doc_id, license, containment, first_word, last_word (of the window; words from 0).

    ``docs`` has doc_id and text; other columns are left out. Words count
    without ASCII signs at their ends and with A-Z as a-z. ``templates`` are notices
    by license; one of fewer than ``shingle`` words is left out. A row is the best window of a document for a
    license, from a ``contained`` share of a notice's shingles on; close relatives (GPL versions, BSD clauses) each give a row, the right one with the larger share. Null or empty texts hold none; a null doc_id stays null; repeated rows give repeated results.
    """
    known = _classes(NOTICES if templates is None else templates, rows, bands, shingle)
    seeds = _seeds(rows, bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            names = batch.column("doc_id").cast(pa.int64())
            for whole in texts(batch.column("text"), lower=True):
                part = _trimmed(whole)
                grams = gram_hashes(word_hashes(part), shingle)
                best: dict[tuple[int, str], tuple[float, int, int]] = {}
                for cls, i, k, b, e in _retrieve(part, grams, known, seeds, rows, shingle, contained) if len(grams) else ():
                    share = float(np.isin(cls.grams[k], grams[b:e]).mean())
                    if share >= contained and share > best.get((i, cls.names[k]), (0.0,))[0]:
                        at = int(part.bounds[i])
                        best[i, cls.names[k]] = (share, b - at, e + shingle - 2 - at)
                out += [(whole.first + i, name, *x) for (i, name), x in best.items()]
            if out:
                which, *rest = map(list, zip(*out))
                cols = [names.take(pa.array(which)), pa.array(rest[0]), pa.array(rest[1], pa.float64()), *(pa.array(x, pa.int64()) for x in rest[2:])]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "license", "containment", "first_word", "last_word"])

    return docs.select("doc_id", "text").mapInArrow(run, _HIT)
