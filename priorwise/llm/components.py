"""Connected components of a link table by min-label stars, entirely as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorwise.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b) links; a component is named by its smallest node.

    Large-star and small-star steps in turn: every node is linked to the smallest node around it, until
    nothing changes. A node of very many links costs one partial minimum per task.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(both.filter("a > b").distinct())
    while True:
        # large star: neighbours above a node go to the smallest of its neighbourhood
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = around.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: neighbours below a node, and the node, go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = stored(small.filter("a <> b").distinct())
        if _digest(after) == _digest(edges):
            break
        edges = after
    own = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own)


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
