"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, root) of every node with an edge to another one; root is the smallest node that it reaches.

    Each round is two shuffle joins on the node; no node's neighbours are gathered in one place, and the rounds grow
    with the logarithm of the longest path. Tables are checkpointed in the shared folder, only a count and a hash come
    to the driver. Edges with a null end and loops are left out; an empty table has no components.
    """
    edges = checkpoint(edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _digest(edges)
    while seen[0]:
        # Large star: all larger neighbours of a node meet its smallest neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: a node and its smaller neighbours meet the smallest of them.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        edges = checkpoint(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
