"""Connected components of a graph given as edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` for every node of the edges ``(a long, b long)``: comp is the smallest node
    that can be reached, itself included. Self edges keep a node without neighbours.

    The number of rounds grows with the logarithm of the component size, not with path length.
    Every round is materialised; a round that changes nothing ends it."""
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = (F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")))
    seen = now.agg(*mark).first()
    while seen[0]:
        now = materialize(_small_star(_large_star(now)))
        after = now.agg(*mark).first()
        if after == seen:
            break
        seen = after
    # every edge now leads from a node to the smallest of its component
    return nodes.join(now.withColumnsRenamed({"a": "node", "b": "comp"}), "node", "left").select(
        "node", F.coalesce("comp", "node").alias("comp"))
