"""Sums of products per series, and regressions solved from them.

The Gram matrix of (1, x, y) is all that a linear, ridge or lasso regression
needs of its rows. It is one grouped aggregate inside the JVM: each row is sent
on once for every row of the matrix, and map-side sums shrink them at once. The
matrices of two sets of rows add up to that of both, so a model can be fitted
again on old and new rows from the new rows alone.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAT = 1e-11  # a variance below this share of the mean square is rounding noise
NOISE = 1e-6  # a mean square below this share of that of y is not explained any further
RANK = 1e-12  # eigenvalues below this share of the largest carry no information


def gram_sums(df: DataFrame, keys: Sequence[str], x: str, y: str, size: int) -> DataFrame:
    """(keys, gram): sums of products of (1, x…, y) by series, the rows of the matrix one after the other.

    ``x`` is an array column of ``size`` numbers. Rows with a null take no part.
    """
    z = df.select(*keys, F.concat(F.array(F.lit(1.0)), F.col(x), F.array(F.col(y).cast("double"))).alias("_z"))
    z = z.where(F.forall("_z", lambda v: v.isNotNull())).select(*keys, "_z", F.posexplode("_z").alias("_i", "_v"))
    products = F.array(*[F.sum(F.col("_v") * F.col("_z")[j]) for j in range(size + 2)])
    lines = z.groupBy(*keys, "_i").agg(products.alias("_g"))
    # one line for each row of the matrix, however many rows the series has
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_g"))), lambda s: s["_g"]))
    return lines.groupBy(*keys).agg(whole.alias("gram"))


def added(a: Column, b: Column) -> Column:
    """The matrix of two sets of rows; a missing one counts as no rows."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda p, q: p + q))


class Moments:
    """Means, standard deviations (population) and standardised products out of one series' sums."""

    def __init__(self, gram: Sequence[float]):
        k = int(round(len(gram) ** 0.5))
        g = np.asarray(gram, dtype=float).reshape(k, k)
        self.n = g[0, 0]
        mean = g[0] / self.n
        cov = g / self.n - np.outer(mean, mean)
        var = np.maximum(np.diag(cov), 0.0)
        var = np.where(var <= FLAT * np.diag(g) / self.n, 0.0, var)
        self.mean, self.center, self.total = float(mean[-1]), mean[1:-1], float(var[-1])
        self.width = np.where(var[1:-1] > 0, np.sqrt(var[1:-1]), 1.0)
        live = var[1:-1] > 0
        self.products = np.where(np.outer(live, live), cov[1:-1, 1:-1] / np.outer(self.width, self.width), 0.0)
        self.target = np.where(live, cov[1:-1, -1] / self.width, 0.0)

    def correlations(self) -> np.ndarray:
        """Absolute correlation of each column with y; -1 where one does not vary."""
        live = np.diag(self.products) > 0
        return np.where(live & (self.total > 0), np.abs(self.target) / np.sqrt(max(self.total, 1e-300)), -1.0)

    def pick(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.products[np.ix_(columns, columns)], self.target[columns]


def least_squares(products: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The shortest of the solutions that fit best."""
    values, vectors = np.linalg.eigh(products)
    keep = values > RANK * max(values.max(initial=0.0), 1e-300)
    return vectors[:, keep] @ ((vectors[:, keep].T @ target) / values[keep])


def ridge(products: np.ndarray, target: np.ndarray, alpha: float, n: float) -> np.ndarray:
    """Minimise |y - zb|^2 + alpha |b|^2 by a Cholesky factor."""
    lower = np.linalg.cholesky(products * n + alpha * np.eye(len(target)))
    return np.linalg.solve(lower.T, np.linalg.solve(lower, target * n))


def lasso(products: np.ndarray, target: np.ndarray, alpha: float, rounds: int = 2000) -> np.ndarray:
    """Minimise |y - zb|^2 / (2n) + alpha |b|_1 by covariance updates: no row is looked at again.

    Coordinate steps find which coefficients are non-zero; their values are
    then solved for exactly and accepted once the optimality conditions hold.
    """
    beta = np.zeros(len(target))
    for turn in range(rounds):
        for j in np.flatnonzero(np.diag(products) > 0):
            pull = target[j] - products[j] @ beta + products[j, j] * beta[j]
            beta[j] = np.sign(pull) * max(abs(pull) - alpha, 0.0) / products[j, j]
        if turn % 10 == 9:
            active, signs = beta != 0, np.sign(beta)
            exact = np.zeros(len(target))
            exact[active] = np.linalg.lstsq(products[np.ix_(active, active)], target[active] - alpha * signs[active], rcond=None)[0]
            slack = np.abs(target - products @ exact)
            if np.all(np.sign(exact) == signs) and np.all(slack <= alpha * (1 + 1e-7) + 1e-9):
                return exact
            # otherwise go towards it as far as the signs hold; the first to reach zero leaves
            turned = np.flatnonzero(active & (np.sign(exact) != signs))
            if len(turned):
                reach = beta[turned] / (beta[turned] - exact[turned])
                beta = beta + reach.min() * (exact - beta)
                beta[turned[reach.argmin()]] = 0.0
            else:
                beta = exact
    return beta


# ---- sparse choice ---------------------------------------------------------------------------


class Sparse:
    """Which of some columns a series needs beside others that are always there, by an L1 path over its sums of products.

    The others (and the level) are projected out. Coordinate steps with
    covariance updates go down a path of penalties, each from the solution
    before; every set of columns on the path is fitted without penalty, and the
    set with the lowest Bayesian criterion stays, less the columns it can
    spare. A column costs two parameters, its size and its place. What is under a
    thousandth of the level of y (its root mean square) counts as noise.
    """

    def __init__(self, gram: Sequence[float], chosen: Sequence[int], always: Sequence[int]):
        k = int(round(len(gram) ** 0.5))
        g = np.asarray(gram, dtype=float).reshape(k, k)
        self.n, y = float(g[0, 0]), k - 1
        g = g / self.n
        base = np.array([0, *(i + 1 for i in always)])
        own = np.array([i + 1 for i in chosen])
        scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
        g = g / np.outer(scale, scale)
        values, vectors = np.linalg.eigh(g[np.ix_(base, base)])
        keep = values > RANK * values.max()
        half = vectors[:, keep] / np.sqrt(values[keep])
        left = g - g[:, base] @ half @ half.T @ g[base]
        self.base, self.total = int(keep.sum()), max(float(left[y, y]), 0.0)
        self.rest = left[np.ix_(own, own)]
        self.pull = left[own, y]
        self.flat = np.diag(self.rest) <= FLAT
        self.size = np.where(self.flat, 1.0, np.sqrt(np.maximum(np.diag(self.rest), FLAT)))
        self.unit = scale[y] / scale[own]
        self.noise = NOISE

    def fitted(self, columns: Sequence[int]) -> tuple[np.ndarray, float]:
        """Coefficients of some columns without penalty, and the mean square that is left."""
        at = np.asarray(columns, dtype=int)
        b = least_squares(self.rest[np.ix_(at, at)], self.pull[at]) if len(at) else np.zeros(0)
        return b, max(self.total - float(b @ self.pull[at]), 0.0)

    def criterion(self, columns: Sequence[int]) -> float:
        return self.n * np.log(self.fitted(columns)[1] + self.noise) + (self.base + 2 * len(columns)) * np.log(self.n)

    def path(self, steps: int = 40, least: float = 0.005) -> list[tuple[float, np.ndarray]]:
        """(penalty, standardised coefficients) from the largest penalty that leaves something down."""
        live = np.flatnonzero(~self.flat)
        z, c = self.rest / np.outer(self.size, self.size), self.pull / self.size
        top = float(np.abs(c[live]).max(initial=0.0))
        b, out = np.zeros(len(c)), []
        for alpha in top * np.geomspace(1.0, least, steps) if top > 0 else ():
            for _ in range(500):
                before = b.copy()
                for j in live:
                    at = c[j] - z[j] @ b + z[j, j] * b[j]
                    b[j] = np.sign(at) * max(abs(at) - alpha, 0.0) / z[j, j]
                if np.abs(b - before).max() <= 1e-10 * top:
                    break
            out.append((float(alpha), b.copy()))
        return out

    def best(self) -> np.ndarray:
        """Coefficients in the columns' own units; 0 for those that are not needed."""
        sets = {(): self.criterion(())}
        if self.total > self.noise:
            for _, b in self.path():
                own = tuple(np.flatnonzero(b).tolist())
                if own not in sets and len(own) + self.base < self.n - 1:
                    sets[own] = self.criterion(own)
        chosen = min(sets, key=lambda x: (sets[x], len(x)))
        while chosen:  # drop what can be spared
            fewer = min((tuple(c for c in chosen if c != d) for d in chosen), key=self.criterion)
            if self.criterion(fewer) > self.criterion(chosen):
                break
            chosen = fewer
        out = np.zeros(len(self.pull))
        out[list(chosen)] = self.fitted(chosen)[0] * self.unit[list(chosen)] if chosen else 0.0
        return out
