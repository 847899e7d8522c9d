"""Queries of the search network: nodes(id_hash, behavior, ...) and edges(_from, _to, iteration, fitness)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed


def top_elites(nodes: DataFrame, edges: DataFrame, n: int = 3) -> DataFrame:
    """The nodes at the end of the n fittest edges, of equals the latest."""
    top = edges.groupBy("_to", "fitness").agg(F.max("iteration").alias("iteration")).orderBy("fitness", F.desc("iteration"), "_to").limit(n)
    return nodes.join(top, F.col("id_hash") == F.col("_to")).select(*[nodes[c] for c in nodes.columns], "fitness", "iteration")


def behaviours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(behavior, newness): the last iteration that reached a behaviour."""
    return edges.join(nodes, F.col("_to") == F.col("id_hash")).groupBy("behavior").agg(F.max("iteration").alias("newness"))


def _running(rows: DataFrame, weight: str, key: str) -> DataFrame:
    """rows with ``__start``, the sum of the weights before each in the order of the key: ranges are summed apart, then shifted by those before."""
    cut = checkpointed(rows.repartitionByRange(key).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = cut.groupBy("__part").agg(F.sum(weight).alias("__w")).select("__part", F.coalesce(F.sum("__w").over(before), F.lit(0.0)).alias("__shift"))
    inside = F.coalesce(F.sum(weight).over(Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return cut.withColumn("__in", inside).join(F.broadcast(starts), "__part").withColumn("__start", F.col("__shift") + F.col("__in")).drop("__part", "__in", "__shift")


def sample_weighted(rows: DataFrame, n: int, weight: str, key: str, seed: int = 0) -> DataFrame:
    """rows with ``draw``: n draws with replacement, each likelier by weight.

    Each row holds a stretch of the line as long as its weight; n seeded numbers fall on the line, and each takes the
    last row that starts before it. Rows and numbers are sorted together by range, so no row is copied for each draw, and
    only the last row of a range is handed on to the next. Rows without a positive, finite weight are never drawn.
    """
    names = rows.columns
    w = F.col(weight).cast("double")
    weighed = rows.where((w > 0) & (w < float("inf"))).withColumn("__w8", w)
    placed = checkpointed(_running(weighed, "__w8", key))
    total = placed.agg(F.max(F.col("__start") + F.col("__w8"))).first()[0]
    if total is None or n < 1:
        return rows.limit(0).withColumn("draw", F.lit(0))
    u = (F.shiftrightunsigned(F.xxhash64("id", F.lit("draw"), F.lit(seed)), 11) + 0.5) / float(1 << 53)
    numbers = rows.sparkSession.range(n).select((u * total).alias("__at"), F.col("id").cast("int").alias("draw"))
    both = placed.select(F.col("__start").alias("__at"), F.struct(*[f"`{c}`" for c in names]).alias("__row")).unionByName(numbers, allowMissingColumns=True)
    # Of one place the row comes first: a number that falls on a start takes that row.
    order = ["__at", F.col("draw").isNotNull()]
    cut = checkpointed(both.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    lasts = cut.where("__row is not null").groupBy("__part").agg(F.max_by("__row", "__at").alias("__last"))
    parts = cut.select("__part").distinct().join(lasts, "__part", "left")
    handed = parts.select("__part", F.last("__last", ignorenulls=True).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__handed"))  # one row for each range
    inside = F.last("__row", ignorenulls=True).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    met = cut.withColumn("__row", inside).where("draw is not null").join(F.broadcast(handed), "__part").withColumn("__row", F.coalesce("__row", "__handed"))
    return met.select(*[F.col("__row").getField(c).alias(c) for c in names], "draw")


def fittest_of(nodes: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """The fittest node of each wanted behaviour; of equals the smaller id_hash. Every task keeps one node a behaviour before the shuffle."""
    ids = nodes.join(wanted.select("behavior"), "behavior", "left_semi")
    reached = edges.select("_to", "fitness").join(ids, F.col("_to") == F.col("id_hash")).drop("_to")
    columns = [c for c in reached.columns if c != "behavior"]
    best = reached.groupBy("behavior").agg(F.min_by(F.struct(*columns), F.struct("fitness", "id_hash")).alias("__row"))
    return best.select("behavior", *[F.col("__row").getField(c).alias(c) for c in columns]).select(*[c for c in ids.columns], "fitness")


def best_fitness(edges: DataFrame) -> DataFrame:
    return edges.agg(F.min("fitness").alias("best"))


def next_population(nodes: DataFrame, edges: DataFrame, elites: int, sampled: int, seed: int = 0) -> DataFrame:
    """The top elites and the fittest of some behaviours, newer ones likelier."""
    columns = [*nodes.columns, "fitness"]
    chosen = sample_weighted(behaviours(nodes, edges), sampled, "newness", "behavior", seed)
    return top_elites(nodes, edges, elites).select(*columns).unionByName(fittest_of(nodes, edges, chosen).select(*columns))
