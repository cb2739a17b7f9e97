"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every neighbour (large: the larger ones) of a node to the smallest node of its neighbourhood.

    The smallest neighbours are aggregated map-side and written before the join, so the rows of a
    very large neighbourhood meet one row and adaptive execution can split them.
    """
    if large:
        pairs = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = cut_lineage(pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")))
    joined = pairs.join(low, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(low.select("a", F.col("low").alias("b")))
    return cut_lineage(out.where(F.col("a") != F.col("b")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable.

    Self links and nulls are left out; repeated links are one. Rounds grow with the logarithm of the
    number of nodes; each one is checkpointed, so a lost executor repeats one round at most.
    """
    edges = cut_lineage(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    before = None
    while True:
        edges = _star(_star(edges, large=True), large=False)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == tuple(now):
            break
        before = tuple(now)
    centres = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        centres.select("node", F.col("node").alias("component"))
    )
