"""Packing lengths into bins of one capacity, for the pieces of one task."""

from __future__ import annotations

import numpy as np


class Room:
    """Bins by the room they have left, under a segment tree over capacities.

    A leaf counts the bins with just so much room, an inner node those below
    it; the tightest bin that still fits is found by one walk up and down.
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, which: int) -> None:
        self.bins[room].append(which)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The bin with the least room of ``need`` or more, and that room."""
        at, count = need + self.size, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.size
        which = self.bins[room].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return which, room


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins as lists of places in ``lengths``; the longest go first, equal ones in their order."""
    room, bins = Room(capacity), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = room.take(need)
        if found is None:
            bins.append([i])
            left = capacity - need
            which = len(bins) - 1
        else:
            which, left = found[0], found[1] - need
            bins[which].append(i)
        if left:
            room.add(left, which)
    return bins


class _Search:
    """Underfull bins and what can be exchanged between them."""

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins = [list(b) for b in bins]
        self.fill = np.array([int(lengths[b].sum()) for b in bins], dtype=np.int64)
        self.home = np.empty(len(lengths), dtype=np.int64)
        for k, b in enumerate(self.bins):
            self.home[b] = k

    def refresh(self) -> None:
        """The pieces of underfull bins, and the pairs of them that share a bin."""
        under = (self.fill < self.capacity) & (self.fill > 0)
        self.pieces = np.flatnonzero(under[self.home])
        pairs = [(i, j) for k in np.flatnonzero(under).tolist() for n, i in enumerate(self.bins[k]) for j in self.bins[k][n + 1 :]]
        self.pairs = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        self.sums = self.lengths[self.pairs].sum(1)

    def exchange(self, a: int, give: list[int], b: int, take: list[int]) -> None:
        self.bins[a] = [x for x in self.bins[a] if x not in give] + take
        self.bins[b] = [x for x in self.bins[b] if x not in take] + give
        gain = int(self.lengths[give].sum()) - int(self.lengths[take].sum())
        self.fill[a] -= gain
        self.fill[b] += gain
        self.home[give], self.home[take] = b, a

    def _best(self, size: int, homes: np.ndarray, sizes: np.ndarray, able: np.ndarray) -> int | None:
        """The one to take for pieces of ``size``: most tokens gained within the room of its bin."""
        gain = np.where(able, size - sizes, 0)
        gain[gain > self.capacity - self.fill[homes]] = 0
        k = int(np.argmax(gain)) if len(gain) else 0
        return k if len(gain) and gain[k] > 0 else None

    def step(self, a: int) -> bool:
        """Take tokens out of bin ``a`` into a fuller bin, if any exchange does."""
        lengths, fill, home = self.lengths, self.fill, self.home
        own = sorted(self.bins[a], key=lambda x: -lengths[x])
        gap = self.capacity - fill
        fuller = (fill >= fill[a]) & (gap > 0)
        fuller[a] = False
        for p in own:  # move
            fits = np.flatnonzero(fuller & (gap >= lengths[p]))
            if len(fits):
                self.exchange(a, [p], int(fits[np.argmin(gap[fits])]), [])
                return True
        homes = home[self.pieces]
        able, sizes = fuller[homes], lengths[self.pieces]
        two = [[p, q] for i, p in enumerate(own) for q in own[i + 1 :]]
        for give in [[p] for p in own] + two:  # one or two for one
            k = self._best(int(lengths[give].sum()), homes, sizes, able)
            if k is not None:
                self.exchange(a, give, int(homes[k]), [int(self.pieces[k])])
                return True
        homes = home[self.pairs[:, 0]]
        able = fuller[homes] & (homes == home[self.pairs[:, 1]])
        for p in own:  # one for two
            k = self._best(int(lengths[p]), homes, self.sums, able)
            if k is not None:
                self.exchange(a, [p], int(homes[k]), self.pairs[k].tolist())
                return True
        return False


def improve(lengths: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Fewer bins by local search over the underfull ones.

    From the emptiest bin on, a piece moves to a fuller bin, or changes places
    with one or two shorter pieces there, or two of its pieces with one. Each
    step makes the sum of squared fills larger, so the search ends; bins that
    become empty are dropped. Rounds go on while one empties a bin, down to
    the bound that no packing can beat.
    """
    least = -(-int(lengths.sum()) // capacity)
    search = _Search(lengths, bins, capacity)
    alive = len(bins)
    while alive > least:
        search.refresh()
        for a in np.argsort(search.fill, kind="stable").tolist():
            while 0 < search.fill[a] < capacity and search.step(a):
                pass
            if int((search.fill > 0).sum()) <= least:
                break
        left = int((search.fill > 0).sum())
        if left == alive:
            break
        alive = left
    return [b for b in search.bins if b]
