"""Exact order statistics of large groups, and groups of rows that belong together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

CELLS = 1024  # ranges into which the values between two bounds are counted


def exact_medians(df: DataFrame, by: Sequence[str], columns: Sequence[str], cells: int = CELLS) -> DataFrame:
    """``by``, column, median: the exact median of each column in each group, found by counting.

    Values are counted in ranges between the bounds of their group; the range that holds a wanted rank, with the
    least and greatest value in it, gives the next bounds, until they meet. A pass keeps one count per range, so
    no task holds the values of a group however many there are, and doubles need a handful of passes. Null and
    NaN have no rank; a group without values has no row.
    """
    keys = [*by, "column"]
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    values = df.select(*by, entries.alias("_e")).select(*by, "_e.*").where("value IS NOT NULL AND NOT isnan(value)")
    values = values.withColumn("value", F.col("value") + F.lit(0.0))  # no negative zero
    span = values.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n"))
    ranks = F.array(F.struct(F.lit(0).alias("side"), F.floor((F.col("n") - 1) / 2).alias("rank")), F.struct(F.lit(1).alias("side"), F.floor(F.col("n") / 2).alias("rank")))
    wanted = cut_lineage(span.select(*keys, "low", "high", F.inline(ranks)))
    found = wanted.where("low = high")
    wanted = wanted.where("low < high")
    while not wanted.isEmpty():
        inside = values.join(wanted, keys).where("value BETWEEN low AND high")
        # halves keep the width finite; a value at the upper bound belongs to the last range
        cell = F.least(F.floor((F.col("value") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * cells), F.lit(cells - 1))
        counted = inside.groupBy(*keys, "side", "rank", cell.alias("cell")).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy(*keys, "side").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        chosen = counted.where("before <= rank AND rank < before + n").withColumn("rank", F.col("rank") - F.col("before"))
        step = cut_lineage(chosen.select(*keys, "low", "high", "side", "rank"))
        found, wanted = found.unionByName(step.where("low = high")), step.where("low < high")
    return found.groupBy(*keys).agg(F.avg("low").alias("median"))


def connected_groups(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """(member, group): members that pairs connect, directly or through others, named by the least of them.

    In each round a member takes the least name among its own and its neighbours', then the name that this one
    has taken, so names travel twice as far each time. Both are joins and partial minima.
    """
    edges = pairs.select(F.col(first).alias("a"), F.col(second).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    edges = cut_lineage(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    names = cut_lineage(edges.groupBy(F.col("a").alias("member")).agg(F.least(F.min("b"), F.first("a")).alias("group")))
    while True:
        near = edges.join(names.withColumnRenamed("member", "b"), "b").groupBy(F.col("a").alias("member")).agg(F.min("group").alias("near"))
        least = names.join(near, "member").select("member", F.least("group", "near").alias("taken"), F.col("group").alias("old"))
        jump = least.select(F.col("member").alias("taken"), F.col("taken").alias("further"))
        step = least.join(jump, "taken").select("member", F.least("taken", "further").alias("group"), (F.col("old") != F.least("taken", "further")).alias("moved"))
        step = cut_lineage(step)
        names = step.select("member", "group")
        if step.where("moved").isEmpty():
            return names
