"""Connected components of an edge list, as DataFrame joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import forget, written


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node of each component) for edges (a, b); nodes without an edge aren't returned.

    Large-star and small-star steps alternate until nothing changes: every node hangs its larger neighbours, then its smaller ones, on the
    smallest it knows. Rounds grow with the logarithm of the longest chain. A node's neighbours are never gathered: the smallest is an
    aggregate with partial results in each task, joined back to the edges, where Spark's adaptive execution splits a hot node. Each
    round is written to the shared folder, so lost executors cost one round at most. Loops and repeated edges do no harm.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    before = None
    while True:
        # Large star: of all a node's neighbours and itself the smallest takes the larger ones.
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").selectExpr("v AS hi", "m AS lo").distinct()
        # Small star: of the smaller neighbours the smallest takes the others and the node.
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").selectExpr("explode(array(struct(hi AS hi, m AS lo), struct(lo AS hi, m AS lo))) AS e").select("e.*").where("hi <> lo").distinct()
        last, edges = edges, written(small, "edges")
        forget(last)
        now = edges.agg(F.count("hi"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(edges.select("lo", "lo").distinct())
