"""Quantiles of Student's t, a small numeric helper (no statistics library is assumed).

The cumulative function is a regularised incomplete beta function, evaluated
by its continued fraction in a few dozen steps whatever the degrees of freedom,
and inverted by bisection.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

_TINY = 1e-300
LARGE = 100_000  # from here on the expansion around the normal quantile is exact to rounding


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, from the front (modified Lentz)."""
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or _TINY)
    out = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 / (1.0 + term * d or _TINY)
            c = 1.0 + term / c or _TINY
            out *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return out


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1.0) / (a + b + 2.0):  # the fraction converges fast on the other side
        return 1.0 - _beta_share(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a


def t_cdf(t: float, dof: int) -> float:
    """P(T <= t)."""
    tail = 0.5 * _beta_share(dof / 2.0, 0.5, dof / (dof + t * t))
    return 1.0 - tail if t > 0 else tail


@lru_cache(maxsize=4096)
def t_quantile(p: float, dof: int) -> float:
    if dof < 1 or not 0.0 < p < 1.0:
        return float("nan")
    if p < 0.5:
        return -t_quantile(1.0 - p, dof)
    if dof >= LARGE:
        z = NormalDist().inv_cdf(p)
        return z + (z**3 + z) / (4 * dof) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * dof**2)
    lo, hi = 0.0, 1.0
    while t_cdf(hi, dof) < p:
        lo, hi = hi, hi * 2
    for _ in range(100):
        mid = 0.5 * (lo + hi)
        lo, hi = (mid, hi) if t_cdf(mid, dof) < p else (lo, mid)
    return 0.5 * (lo + hi)
