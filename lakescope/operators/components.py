"""Connected components by alternating large-star and small-star contraction.

Rounds grow with the logarithm of the number of nodes, not with the diameter. Hubs are handled by a minimum
for each node (partial sums before the shuffle) and a join with one row on the other side, which adaptive
skew handling can split; no neighbourhood is gathered in one place. Every round is written to the shared
checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescope.session import cut_lineage


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def star_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node with an edge to another node; the component is its least node."""
    e = cut_lineage(_ordered(edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))))
    before = _state(e)
    while True:
        # large star: a node's larger neighbours go to the least of the node and its neighbours
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _ordered(both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        # small star: a node and its smaller neighbours go to the least of these
        large = cut_lineage(large)
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        e = cut_lineage(_ordered(small.select(F.col("hi").alias("a"), F.col("m").alias("b")).unionByName(
            small.select(F.col("lo").alias("a"), F.col("m").alias("b")))))
        after = _state(e)
        if after == before:
            break
        before = after
    leaves = e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return leaves.unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
