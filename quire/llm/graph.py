"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two grouped minima over the edges; the number of rounds grows
with the logarithm of the longest path.  Edges are checkpointed each round in
the shared folder, so a lost executor costs one round at most.  A node's edges
are never gathered in one task: a window-free ``groupBy().min()`` with partial
sums finds the smallest neighbour, and hot nodes are only join keys that the
adaptive skew join can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over ``(a, b)`` with a > b."""
    if large:
        pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges
    low = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = pairs.join(low, "a")
    if large:
        new = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        new = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return new.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of long ids -> ``(node, component)``: the smallest id reachable.

    Nodes without an edge to another node are not in the result.  Nulls,
    loops and repeated or reversed edges are allowed.  No edge: no rows.
    """
    e = cut_lineage(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        e = cut_lineage(_stars(_stars(e, large=True), large=False))
        # the edge set determines these sums; they stop changing when all trees are stars
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = now
