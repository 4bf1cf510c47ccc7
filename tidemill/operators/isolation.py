"""Isolation forest as a Spark job.

Trees are grown on small uniform samples chosen by a hash of the row id, so a
score depends on the data and the seed alone, never on how rows are
partitioned. On raw rows the forest (a bounded number of nodes) is broadcast and
rows are scored where they lie; on a panel of reduced series each series has
its own forest, grown and applied inside its group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import attach, by_time, per_series, ratio, spread

# Rows each tree is grown on unless stated otherwise.
SAMPLE = 256
EULER = 0.5772156649015329
TREE_BLOCK = 10
# Trees of a forest as three (tree, node) arrays; node i has children 2i+1 and 2i+2.
Forest = tuple[np.ndarray, np.ndarray, np.ndarray]


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0) - 1.0
    long = 2.0 * (np.log(big) + EULER) - 2.0 * big / (big + 1.0)
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def grow_forest(samples: np.ndarray, seed: Sequence[int]) -> Forest:
    """Random trees on samples of shape (trees, rows, features), all trees growing level by level together.

    ``feature`` is -1 at a leaf, whose ``path`` is its depth plus the expected
    path through the rows that share it.
    """
    n_trees, n_rows, n_features = samples.shape
    depth_limit = max(1, math.ceil(math.log2(max(n_rows, 2))))
    n_nodes = 2 ** (depth_limit + 1) - 1
    rng = np.random.default_rng(list(seed))
    feature = np.full(n_trees * n_nodes, -1)
    cut, path = np.zeros(n_trees * n_nodes), np.zeros(n_trees * n_nodes)
    offset = np.repeat(np.arange(n_trees) * n_nodes, n_rows)
    points, at = samples.reshape(-1, n_features), np.zeros(n_trees * n_rows, dtype=int)
    for depth in range(depth_limit):
        level = np.arange(2**depth - 1, 2 ** (depth + 1) - 1)
        nodes = (np.arange(n_trees)[:, None] * n_nodes + level).ravel()
        low = np.full((n_trees * n_nodes, n_features), np.inf)
        high = np.full((n_trees * n_nodes, n_features), -np.inf)
        np.minimum.at(low, offset + at, points)
        np.maximum.at(high, offset + at, points)
        preference = rng.random((len(nodes), n_features)) * (high[nodes] > low[nodes])
        place = rng.random(len(nodes))
        chosen = preference.argmax(axis=1)
        splits = preference[np.arange(len(nodes)), chosen] > 0
        where, f = nodes[splits], chosen[splits]
        feature[where] = f
        cut[where] = low[where, f] + place[splits] * (high[where, f] - low[where, f])
        here = offset + at
        moving = (feature[here] >= 0) & (at >= level[0])
        goes_right = points[np.arange(len(points)), np.maximum(feature[here], 0)] >= cut[here]
        at = np.where(moving, 2 * at + 1 + goes_right, at)
    held = np.bincount(offset + at, minlength=n_trees * n_nodes)
    depth_of = np.floor(np.log2(np.arange(n_nodes) + 1))
    path[:] = np.tile(depth_of, n_trees) + expected_path(held)
    shape = (n_trees, n_nodes)
    return feature.reshape(shape), cut.reshape(shape), path.reshape(shape)


def forest_score(points: np.ndarray, forest: Forest, sample: int) -> np.ndarray:
    """2 ** (-mean path / expected path): every point descends every tree together."""
    feature, cut, path = forest
    trees = np.arange(len(feature))[:, None]
    at = np.zeros((len(feature), len(points)), dtype=int)
    rows = np.arange(len(points))[None, :]
    while True:
        f = feature[trees, at]
        inner = f >= 0
        if not inner.any():
            break
        right = points[rows, np.maximum(f, 0)] >= cut[trees, at]
        at = np.where(inner, 2 * at + 1 + right, at)
    mean_path = path[trees, at].mean(axis=0)
    return np.power(2.0, -mean_path / max(float(expected_path(sample)), 1e-12))


def draw_samples(points: np.ndarray, hashes: np.ndarray, trees: Sequence[int], seed: int, sample_rows: int = SAMPLE) -> np.ndarray:
    """Per tree, the rows with the smallest re-hashed ids: uniform samples that ignore row order."""
    size = min(sample_rows, len(points))
    ids = np.ascontiguousarray(hashes).view(np.uint64)
    out = np.empty((len(trees), size, points.shape[1]))
    for i, tree in enumerate(trees):
        salt = np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
        mixed = (ids ^ salt) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(33)
        out[i] = points[np.lexsort((ids, mixed))[:size]]
    return out


def isolation_scores(
    df: DataFrame,
    keys: Sequence[str] = (),
    row_id: Sequence[str] = ("ts",),
    features: Sequence[str] = ("y",),
    scale: str = "series",
    seed: int = 42,
    trees: int = 100,
    sample_rows: int = SAMPLE,
    pool_rows: int | None = None,
) -> DataFrame:
    """The frame with ``outlier_score_isolation`` (0..1, higher is odder).

    Features are standardised per key (population std, a constant one is 0).
    ``row_id`` identifies a row within its key and seeds the samples. For
    ``scale="series"`` nulls are filled in time order first and each key has its
    own forest; for ``scale="rows"`` nulls count as the key's mean and there is
    one forest over all rows. Each tree is grown on ``sample_rows`` rows; of raw
    rows all trees draw theirs from a uniform sample of ``pool_rows`` of the
    whole table (``trees * sample_rows`` unless stated, so that the trees' samples
    overlap little). Every row is scored.
    """
    if scale == "rows":
        return _score_rows(df, keys, row_id, features, seed, trees, sample_rows, pool_rows or trees * sample_rows)
    order, whole = by_time(keys, row_id[0]), per_series(keys)
    filled = {
        f"_f{i}": F.coalesce(
            F.last(c, True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            F.first(c, True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).cast("double")
        for i, c in enumerate(features)
    }
    scaled = [
        F.coalesce(ratio(F.col(f) - F.avg(f).over(whole), F.stddev_pop(f).over(whole)), F.lit(0.0)) for f in filled
    ]
    work = df.withColumns(filled).withColumns({"_x": F.array(*scaled), "_h": F.xxhash64(*keys, *row_id)}).drop(*filled)
    schema = T.StructType([*work.schema.fields, T.StructField("outlier_score_isolation", T.DoubleType())])

    def one_series(pdf: pd.DataFrame) -> pd.DataFrame:
        points, hashes = np.vstack(pdf["_x"].to_numpy()).astype(float), pdf["_h"].to_numpy()
        forest = grow_forest(draw_samples(points, hashes, range(trees), seed, sample_rows), [seed])
        return pdf.assign(outlier_score_isolation=forest_score(points, forest, min(sample_rows, len(points))))

    return spread(work, *keys).groupBy(*keys).applyInPandas(one_series, schema).drop("_x", "_h")


def _score_rows(
    df: DataFrame, keys: Sequence[str], row_id: Sequence[str], features: Sequence[str], seed: int, trees: int, sample_rows: int, pool_rows: int
) -> DataFrame:
    """One forest for all rows: pool -> trees grown in blocks -> broadcast nodes -> vectorised scoring.

    The pool is the ``pool_rows`` rows with the smallest hashes, a uniform
    sample of fixed size found by a top-k, not a sort. Sampling is part of the
    method; every row is scored.
    """
    facts = df.groupBy(*keys).agg(
        *[
            F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(f"f{i}")
            for i, c in enumerate(features)
        ]
    )
    scaled = [
        F.coalesce(ratio(F.col(c) - F.col(f"_s.f{i}.mean"), F.col(f"_s.f{i}.std")), F.lit(0.0))
        for i, c in enumerate(features)
    ]
    work = attach(df, facts, keys, "_s", raw=True).withColumns(
        {"_x": F.array(*scaled), "_h": F.xxhash64(*keys, *row_id)}
    )
    pool = (
        work.select("_h", "_x")
        .orderBy("_h", "_x")
        .limit(pool_rows)
        .agg(F.collect_list("_h").alias("hashes"), F.collect_list("_x").alias("points"))
    )

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, hashes, packed in zip(pdf["block"], pdf["hashes"], pdf["points"]):
                if len(hashes) == 0:
                    continue
                points = np.vstack(packed).astype(float)
                mine = range(block * TREE_BLOCK, min((block + 1) * TREE_BLOCK, trees))
                forest = grow_forest(draw_samples(points, np.asarray(hashes, dtype=np.int64), mine, seed, sample_rows), [seed, block])
                flat = [part.astype(float).ravel() for part in forest]
                yield pd.DataFrame(
                    {"block": [block], "n_trees": [len(mine)], "size": [min(sample_rows, len(points))],
                     "feature": [flat[0]], "cut": [flat[1]], "path": [flat[2]]}
                )

    blocks = F.sequence(F.lit(0), F.lit((trees - 1) // TREE_BLOCK))
    grown = spread(pool.withColumn("block", F.explode(blocks)), "block").mapInPandas(
        build, "block int, n_trees int, size int, feature array<double>, cut array<double>, path array<double>"
    )
    parts = sorted(grown.collect(), key=lambda r: r["block"])  # a bounded number of nodes

    def stacked(name: str) -> np.ndarray:
        return np.vstack([np.array(r[name]).reshape(r["n_trees"], -1) for r in parts])

    if parts:
        forest = (stacked("feature").astype(int), stacked("cut"), stacked("path"))
        shared = df.sparkSession.sparkContext.broadcast((forest, parts[0]["size"]))
    else:
        shared = df.sparkSession.sparkContext.broadcast(None)

    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series) -> pd.Series:
        trained, size = shared.value
        return pd.Series(forest_score(np.vstack(x.to_numpy()).astype(float), trained, size))

    return work.withColumn("outlier_score_isolation", score("_x")).select(*df.columns, "outlier_score_isolation")
