"""Jaccard self-join of one block of sets by a signature tree.

Leaves hold a bitmap of a set's elements, its size and its component; a node
above holds the OR of its children's bitmaps and the range of their sizes. Two
trees are walked together from their roots. A pair of nodes is left out when
no two of their sets can link: the sizes are too far apart, everything is one
component already, or the overlap that the bitmaps allow is too small. What
remains at the leaves is checked exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FAN = 8
PAIRS = 1 << 16  # node pairs looked at together


@dataclass
class _Level:
    bits: np.ndarray
    low: np.ndarray  # smallest and largest set below
    high: np.ndarray
    slack: np.ndarray  # most elements of a set that share a bit with another of its own


class Sets:
    """Union-find over the sets of a block."""

    def __init__(self, comps: np.ndarray):
        _, first, inverse = np.unique(comps, return_index=True, return_inverse=True)
        self.up = first[inverse].astype(np.int64)

    def roots(self) -> np.ndarray:
        while True:
            top = self.up[self.up]
            if np.array_equal(top, self.up):
                return top
            self.up = top

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def join(self, i: int, j: int) -> None:
        self.up[max(i, j)] = min(i, j)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = overlap(a, b)
    return 100 * common >= percent * (len(a) + len(b) - common)


def _leaves(sets: list[np.ndarray]) -> _Level:
    sizes = np.array([len(s) for s in sets])
    width = 1 << int(np.clip(np.ceil(np.log2(4 * max(1.0, np.median(sizes)))), 9, 15))
    bits = np.zeros((len(sets), width // 64), dtype=np.uint64)
    for i, s in enumerate(sets):
        flag = np.zeros(width, dtype=bool)
        flag[(s & np.uint64(width - 1)).astype(np.int64)] = True
        bits[i] = np.packbits(flag).view(np.uint64)
    return _Level(bits, sizes, sizes, sizes - np.bitwise_count(bits).sum(1, dtype=np.int64))


def _above(level: _Level) -> _Level:
    cuts = np.arange(0, len(level.low), FAN)
    return _Level(
        np.bitwise_or.reduceat(level.bits, cuts, axis=0), np.minimum.reduceat(level.low, cuts),
        np.maximum.reduceat(level.high, cuts), np.maximum.reduceat(level.slack, cuts),
    )


def _children(pairs: np.ndarray, n: int) -> np.ndarray:
    """Pairs of children, each once; ``n`` is the number of nodes on their level."""
    i, j = np.divmod(np.arange(FAN * FAN), FAN)
    left = (pairs[:, :1] * FAN + i).ravel()
    right = (pairs[:, 1:] * FAN + j).ravel()
    keep = (left <= right) & (right < n)
    return np.stack([left[keep], right[keep]], 1)


def links(sets: list[np.ndarray], comps: np.ndarray, percent: int = 75) -> list[tuple[int, int]]:
    """Links found between sets of different components: enough to join all that are linked, each checked exactly.

    A pair of one component is not looked at. The result has fewer rows than the block has sets.
    """
    found: list[tuple[int, int]] = []
    if len(sets) == 2:
        small, large = sorted(map(len, sets))
        if comps[0] != comps[1] and small and 100 * small >= percent * large and linked(*sets, percent):
            found.append((0, 1))
        return found
    order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]) if len(sets[i]) else 0, len(sets[i])))
    sets, comps = [sets[i] for i in order], np.asarray(comps)[order]
    union = Sets(comps)
    levels = [_leaves(sets)]
    while len(levels[-1].low) > FAN:
        levels.append(_above(levels[-1]))
    top = len(levels) - 1
    n = len(levels[top].low)
    stack = [(top, np.stack(np.triu_indices(n), 1))]
    while stack:
        at, pairs = stack.pop()
        if len(pairs) > PAIRS:
            stack.append((at, pairs[PAIRS:]))
            pairs = pairs[:PAIRS]
        level, (x, y) = levels[at], pairs.T
        root = union.roots()
        step = FAN**at
        first, last = np.minimum.reduceat(root, np.arange(0, len(root), step)), np.maximum.reduceat(root, np.arange(0, len(root), step))
        open_ = ~((first[x] == last[x]) & (first[y] == last[y]) & (first[x] == first[y]))
        open_ &= (100 * level.high[x] >= percent * level.low[y]) & (100 * level.high[y] >= percent * level.low[x])
        pairs = pairs[open_]
        if at == 0:
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        x, y = pairs.T
        most = np.empty(len(pairs), dtype=np.int64)
        for k in range(0, len(pairs), 4096):
            both = level.bits[x[k : k + 4096]] & level.bits[y[k : k + 4096]]
            most[k : k + 4096] = np.bitwise_count(both).sum(1, dtype=np.int64)
        most += np.minimum(level.slack[x], level.slack[y])
        able = (100 + percent) * most >= percent * (level.low[x] + level.low[y])
        pairs, most = pairs[able], most[able]
        if at:
            # a child level is smaller by FAN squared, so the stack stays a few chunks deep
            for k in range(0, len(pairs), PAIRS // FAN**2):
                stack.append((at - 1, _children(pairs[k : k + PAIRS // FAN**2], len(levels[at - 1].low))))
            continue
        share = most / np.maximum(1, level.low[pairs[:, 0]] + level.low[pairs[:, 1]])
        for i, j in pairs[np.argsort(-share, kind="stable")].tolist():
            a, b = union.find(i), union.find(j)
            if a != b and linked(sets[i], sets[j], percent):
                union.join(a, b)
                found.append((order[i], order[j]))
    return found
