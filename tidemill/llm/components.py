"""Connected components of a graph given as edges, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import keep


def merge(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of ``edges`` and of ``labels``; comp is the smallest node of the component.

    ``labels`` (node, comp) are components known so far, ``edges`` (a, b) any
    links between nodes. Each round hooks a component to its smallest
    neighbour, halves the pointers twice and contracts the edges, so the
    number of rounds grows with the logarithm of the longest path. Every round
    is aggregates and equi-joins on keys that are hooked in few rows: links of
    a hub are combined before they are shuffled.
    """
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    if labels is None:
        labels = ends.select("node", F.col("node").alias("comp"))
    else:
        new = ends.join(labels.select("node"), "node", "left_anti")
        labels = labels.unionByName(new.select("node", F.col("node").alias("comp")))
    labels = keep(labels, "labels")
    links = _contract(edges, labels)
    while not links.isEmpty():
        low = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        # a component points to its smallest neighbour if that is smaller, else it is a root
        parent = low.select("node", F.least("node", "to").alias("to"))
        for _ in range(2):
            above = parent.select(F.col("node").alias("to"), F.col("to").alias("top"))
            parent = parent.join(above, "to", "left").select("node", F.coalesce("top", "to").alias("to"))
        parent = keep(parent, "parents")
        labels = keep(
            labels.join(parent.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")),
            "labels",
        )
        links = _contract(links, parent.withColumnRenamed("to", "comp"))
    return labels


def _contract(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The distinct links between different components, in both directions."""
    a = labels.select(F.col("node").alias("a"), F.col("comp").alias("x"))
    b = labels.select(F.col("node").alias("b"), F.col("comp").alias("y"))
    found = edges.join(a, "a").join(b, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return keep(found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
