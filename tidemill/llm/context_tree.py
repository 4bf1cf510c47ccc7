"""Context-tree weighting over bytes, from counts of byte sequences.

A byte is eight binary decisions; the node of a decision is the bits before it
and a context of the last 0 to D bytes. Every node estimates its next bit by
Krichevsky-Trofimov, and a node's weighted probability is half its own
estimate's and half the product of its children's, so all depths are mixed by
how well they coded the training data. A trained tree is used as it stands:
the weight of each depth is its posterior. Where a longer context was never
seen in training, the longest that was decides.

A gram is a context and the byte after it, packed with the latest byte of the
context first, so the grams below a node are those with its prefix.
"""

from __future__ import annotations

import math

import numpy as np

HALF = math.log(0.5)


def _lgamma_half(n: np.ndarray, shift: float) -> np.ndarray:
    """log Gamma(n + shift) for counts: by table where small, else by Stirling's series."""
    small = _TABLES[shift]
    out = small[np.minimum(n, len(small) - 1)]
    big = np.flatnonzero(n >= len(small))
    if len(big):
        z = n[big] + shift
        out[big] = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3)
    return out


_TABLES = {shift: np.array([math.lgamma(k + shift) for k in range(1 << 14)]) for shift in (0.5, 1.0)}


def estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that Krichevsky-Trofimov gives to ``n0`` zeros and ``n1`` ones."""
    return _lgamma_half(n0, 0.5) + _lgamma_half(n1, 0.5) - _lgamma_half(n0 + n1, 1.0) - math.log(math.pi)


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, each row's place among them, and sums of the values by key."""
    found, place = np.unique(keys, return_inverse=True)
    return (found, place, *(np.bincount(place, weights=v, minlength=len(found)) for v in values))


def subtree(grams: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Weighted bit probabilities of whole subtrees below contexts of one byte.

    ``grams`` are all grams of these subtrees, each once, with how often
    training has them (it may be 0). Returns, by gram and bit, the probability
    given the contexts of one byte and more (NaN: never seen), and for the
    nodes of one-byte contexts key, zeros, ones and log weighted probability.
    """
    out = np.empty((len(grams), 8))
    roots: list[tuple[np.ndarray, ...]] = []
    byte = grams & np.uint64(0xFF)
    for k in range(8):
        node = np.uint64(1 << k) | (byte >> np.uint64(8 - k))
        bit = ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)
        keys, place, n0, n1 = _sums((grams >> np.uint64(8) << np.uint64(8)) | node, counts * (1 - bit), counts * bit)
        n0, n1 = n0.astype(np.int64), n1.astype(np.int64)
        weighted = estimate(n0, n1)
        total = n0 + n1
        chance = (np.where(bit == 1, n1[place], n0[place]) + 0.5) / (total[place] + 1.0)
        for d in range(depth - 1, 0, -1):
            seen = total[place] > 0
            top = np.uint64((1 << 8 * d) - 1) << np.uint64(8 * (depth - d + 1))  # the d latest bytes
            keys, up, n0, n1, below = _sums((keys & top) | (keys & np.uint64(0xFF)), n0, n1, weighted)
            n0, n1 = n0.astype(np.int64), n1.astype(np.int64)
            own = estimate(n0, n1)
            weighted = np.logaddexp(HALF + own, HALF + below)
            stop = np.exp(HALF + own - weighted)
            total, place = n0 + n1, up[place]
            here = (np.where(bit == 1, n1[place], n0[place]) + 0.5) / (total[place] + 1.0)
            chance = np.where(seen, stop[place] * here + (1 - stop[place]) * chance, here)
        out[:, k] = np.where(total[place] > 0, chance, np.nan)
        roots.append((keys, n0, n1, weighted))
    return out, tuple(np.concatenate(x) for x in zip(*roots))


def root(keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, weighted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the nodes without context, by their bits so far: the posterior weight of stopping there, and the chance of a one."""
    node = (keys & np.uint64(0xFF)).astype(np.int64)
    zeros, ones, below = (np.bincount(node, weights=v, minlength=256) for v in (n0, n1, weighted))
    own = estimate(zeros.astype(np.int64), ones.astype(np.int64))
    return np.exp(HALF + own - np.logaddexp(HALF + own, HALF + below)), (ones + 0.5) / (zeros + ones + 1.0)


def code(grams: np.ndarray, chances: np.ndarray, stop: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Log probability of each gram's last byte."""
    byte = (grams & np.uint64(0xFF)).astype(np.int64)
    total = np.zeros(len(grams))
    for k in range(8):
        node, bit = (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1
        here = np.where(bit == 1, one[node], 1 - one[node])
        p = chances[:, k]
        total += np.log(np.where(np.isnan(p), here, stop[node] * here + (1 - stop[node]) * np.where(np.isnan(p), 0.5, p)))
    return total
