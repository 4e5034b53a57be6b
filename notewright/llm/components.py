"""Connected components of a graph of long ids, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import checkpoint


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): each node that has an edge, and the least node it can reach.

    edges: (u, v), any direction, repeats allowed. Every round links larger neighbours to the
    least neighbour and then smaller ones, so long chains shrink by a power each round, until every
    node is linked to the least of its component and to no other; sums per node are aggregated before
    the shuffle, and nothing is gathered per node.
    """
    pairs = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        ends = pairs.select(F.col("u").alias("k"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(pairs.select(F.col("v").alias("k"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        if ends.groupBy("k").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where(F.col("below") + F.col("above") > 1).where("below > 0").isEmpty():  # every node has one above it, or is one itself
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.col("k")).alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("k"))
        pairs = checkpoint(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
    raise RuntimeError("components did not settle")


def joined(found: DataFrame, edges: DataFrame) -> DataFrame:
    """components() of a graph that had `found` and gets more edges: only components that an edge joins are settled anew."""
    for end in ("u", "v"):
        label = found.select(F.col("node").alias(end), F.col("component").alias("label"))
        edges = edges.join(label, end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    merged = checkpoint(components(edges))
    if merged.isEmpty():
        return found
    further = merged.select(F.col("node").alias("component"), F.col("component").alias("least"))
    return checkpoint(found.join(further, "component", "left").select("node", F.coalesce("least", "component").alias("component")).unionByName(merged.join(found, "node", "left_anti")))
