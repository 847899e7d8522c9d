"""Selection over a population table: elites, tournaments, Pareto fronts, crowding, the archive of cells."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed
from .network import sample_weighted


def worst_last(fitness: Column) -> Column:
    """NULL and NaN count as infinite."""
    return F.coalesce(F.nanvl(fitness, F.lit(float("inf"))), F.lit(float("inf")))


def elites(pop: DataFrame, n: int, fitness: str = "fitness", id_col: str = "ind_id") -> DataFrame:
    """The n fittest; of equals the later one."""
    return pop.orderBy(worst_last(F.col(fitness)), F.desc(id_col)).limit(n)


def _numbered(pop: DataFrame, id_col: str) -> DataFrame:
    """pop with ``__at``, 0, 1, 2 and so on in the order of the id: ranges are sorted apart, then shifted by the rows before them."""
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = checkpointed(pop.repartitionByRange(id_col).sortWithinPartitions(id_col).withColumns({"__part": F.spark_partition_id(), "__in": inside}))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = ranged.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    return ranged.join(F.broadcast(starts), "__part").withColumn("__at", F.col("__start") + F.col("__in")).drop("__part", "__in", "__start")


def tournaments(pop: DataFrame, rounds: int, size: int, fitness: str = "fitness", id_col: str = "ind_id", seed: int = 0) -> DataFrame:
    """(round, ind_id): in each round the fittest of ``size`` different members, drawn by seeded hashes.

    Members are numbered, a round draws numbers, and only the members drawn are joined: the population isn't copied.
    """
    members = _numbered(pop.select(id_col, worst_last(F.col(fitness)).alias("f")), id_col)
    n = members.count()
    spark = pop.sparkSession
    if n <= size:  # all members take part in every round
        best = members.groupBy().agg(F.min_by(id_col, F.struct("f", id_col)).alias(id_col)).where(F.col(id_col).isNotNull())
        return best.select(F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"), id_col)
    # The k-th of a round's numbers is drawn among the n - k that are left and then moved past those drawn before.
    step = lambda drawn, k: F.array_sort(F.array_append(drawn, F.aggregate(drawn, F.pmod(F.xxhash64("round", k, F.lit(seed)), F.lit(n) - k), lambda x, d: F.when(x >= d, x + 1).otherwise(x))))
    numbers = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.array().cast("array<bigint>"), step)
    draws = spark.range(rounds).select(F.col("id").cast("int").alias("round")).withColumn("__at", F.explode(numbers))
    return draws.join(members, "__at").groupBy("round").agg(F.min_by(id_col, F.struct("f", id_col)).alias(id_col))


def _front_of_two(left: DataFrame, a: str, b: str) -> DataFrame:
    """Points that none dominates: of each a the least b, where it is below that of every smaller a.

    The least b for every a comes from a running minimum inside ranges of a, and from the minima of the ranges before.
    """
    least = checkpointed(left.groupBy(a).agg(F.min(b).alias(b)).repartitionByRange(a).withColumn("__part", F.spark_partition_id()))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ranges = least.groupBy("__part").agg(F.min(b).alias("__m")).select("__part", F.min("__m").over(earlier(Window.orderBy("__part"))).alias("__before"))  # one row for each range
    inside = F.min(b).over(earlier(Window.partitionBy("__part").orderBy(a)))
    swept = least.withColumn("__in", inside).join(F.broadcast(ranges), "__part")
    below = F.least("__in", "__before")
    return swept.where(below.isNull() | (F.col(b) < below)).select(a, b)


def _front_of_more(left: DataFrame, objectives: list[str]) -> DataFrame:
    """Points that none dominates: first inside parts by chance, in numpy, then among those that are left."""

    def local(rows: pd.DataFrame) -> pd.DataFrame:
        points = rows[objectives].to_numpy(float)
        points = points[np.argsort(points.sum(axis=1), kind="stable")]  # a point is dominated only by one of a smaller sum
        kept = np.empty((0, len(objectives)))
        for lo in range(0, len(points), 256):
            block = points[lo : lo + 256]
            rivals = np.concatenate([kept, block])
            beaten = np.zeros(len(block), bool)
            for at in range(0, len(rivals), 2048):
                some = rivals[at : at + 2048, None]
                beaten |= ((some <= block).all(axis=2) & (some < block).any(axis=2)).any(axis=0)
            kept = np.concatenate([kept, block[~beaten]])
        return pd.DataFrame(kept, columns=objectives)

    schema = ", ".join(f"`{o}` double" for o in objectives)
    parts = left.select("*", F.pmod(F.xxhash64(*objectives), F.lit(1 << 10)).alias("__part"))
    fronts = checkpointed(parts.groupBy("__part").applyInPandas(lambda rows: local(rows), schema))
    a, b = fronts.alias("a"), fronts.alias("b")
    better, strictly = F.lit(True), F.lit(False)
    for o in objectives:
        better &= F.col(f"b.{o}") <= F.col(f"a.{o}")
        strictly |= F.col(f"b.{o}") < F.col(f"a.{o}")
    return a.join(b, better & strictly, "left_anti").select(*objectives)


def pareto_ranks(pop: DataFrame, objectives: Sequence[str], fronts: int | None = None) -> DataFrame:
    """pop with ``rank``: 1 for members that none dominates (smaller is better), 2 for those that only rank 1 does, and so on.

    With ``fronts`` only so many fronts are found, and only their members returned. One pass a front over the distinct
    points: for two objectives a sort with running minima, for more the fronts of parts, compared with each other.
    """
    objectives = list(objectives)
    left = checkpointed(pop.select(*[worst_last(F.col(o)).alias(o) for o in objectives]).distinct())
    ranked, rank = None, 0
    while (fronts is None or rank < fronts) and not left.isEmpty():
        rank += 1
        front = checkpointed(_front_of_two(left, *objectives) if len(objectives) == 2 else _front_of_more(left, objectives))
        left = checkpointed(left.join(front, objectives, "left_anti"))
        front = front.withColumn("rank", F.lit(rank))
        ranked = front if ranked is None else ranked.unionByName(front)
    if ranked is None:
        return pop.withColumn("rank", F.lit(None).cast("int"))
    ranked = ranked.select(*[F.col(o).alias(f"__{o}") for o in objectives], "rank")
    on = F.lit(True)
    for o in objectives:
        on &= worst_last(F.col(o)) == F.col(f"__{o}")
    return pop.join(ranked, on).drop(*[f"__{o}" for o in objectives])


def _gaps(ranked: DataFrame, objective: str, id_col: str) -> DataFrame:
    """ranked with ``__gap``: the next member's value less the one before's in the front, in the objective's order; NULL at the ends.

    Fronts are cut into ranges; the neighbours at a range's edges come from a table with one row a range and front.
    """
    cut = checkpointed(ranked.repartitionByRange("rank", objective, id_col).withColumn("__part", F.spark_partition_id()))
    order = F.struct(objective, id_col)
    edges = cut.groupBy("rank", "__part").agg(F.min_by(objective, order).alias("first"), F.max_by(objective, order).alias("last"))
    along = Window.partitionBy("rank").orderBy("__part")
    edges = edges.select("rank", "__part", F.lag("last").over(along).alias("__before"), F.lead("first").over(along).alias("__after"))
    inside = Window.partitionBy("rank", "__part").orderBy(objective, id_col)
    near = cut.withColumns({"__lag": F.lag(objective).over(inside), "__lead": F.lead(objective).over(inside)}).join(edges, ["rank", "__part"])
    return near.withColumn("__gap", F.coalesce("__lead", "__after") - F.coalesce("__lag", "__before")).drop("__part", "__lag", "__lead", "__before", "__after")


def crowding(ranked: DataFrame, objectives: Sequence[str], id_col: str = "ind_id") -> DataFrame:
    """ranked with ``crowding``: per objective the gap between the neighbours in the front over its width; the ends are infinite."""
    widths = ranked.groupBy("rank").agg(*[(F.max(o) - F.min(o)).alias(f"__width_{o}") for o in objectives])
    out = ranked.join(widths, "rank").withColumn("crowding", F.lit(0.0))
    for o in objectives:
        room = F.when(F.col("__gap").isNull(), float("inf")).otherwise(F.coalesce(F.try_divide(F.col("__gap"), F.col(f"__width_{o}")), F.lit(0.0)))
        out = _gaps(out, o, id_col).withColumn("crowding", F.col("crowding") + room).drop("__gap")
    return out.select(*ranked.columns, "crowding")


def survivors(ranked: DataFrame, n: int, id_col: str = "ind_id") -> DataFrame:
    """The n of lowest rank; of the last front those with the most room."""
    return ranked.orderBy("rank", F.desc("crowding"), id_col).limit(n)


#: Bytes of centroids that are gathered in one row at once.
GATHERED_BYTES = 16 << 20


def nearest_cell(points: DataFrame, centroids: DataFrame, point: str = "descriptor", centre: str = "centre", cell: str = "cell", id_col: str = "ind_id", most_bytes: int = GATHERED_BYTES) -> DataFrame:
    """(ind_id, cell): the centroid at the least distance, of equals the smallest.

    Centroids are gathered in rows of at most about ``most_bytes``, of which every point meets one after the other and
    keeps the nearest cell so far.
    """
    size = centroids.agg(F.coalesce(F.sum(F.size(centre) * 8 + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // most_bytes))
    squared = lambda c: F.aggregate(F.zip_with(F.col(point), c["at"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    found = points.withColumn("__near", F.lit(None))
    for b in range(blocks):
        block = centroids.where(F.pmod(F.xxhash64(cell), F.lit(blocks)) == b).agg(F.collect_list(F.struct(F.col(centre).alias("at"), F.col(cell).alias("cell"))).alias("__cells"))
        near = F.array_min(F.transform("__cells", lambda c: F.struct(squared(c).alias("d"), c["cell"].alias("cell"))))
        found = found.join(F.broadcast(block), F.lit(True)).withColumn("__near", F.least("__near", near) if b else near).drop("__cells")
    return found.select(id_col, F.col("__near.cell").alias(cell))


def archive_insert(archive: DataFrame, new: DataFrame, cell: str = "cell", fitness: str = "fitness", id_col: str = "ind_id") -> DataFrame:
    """One member per cell: the fittest; of equals the newest. Every task keeps one member a cell before the shuffle."""
    both = archive.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    row = F.struct(*[f"`{c}`" for c in archive.columns])
    best = both.groupBy(F.col(cell).alias("__cell")).agg(F.max_by(row, F.struct(-worst_last(F.col(fitness)), "__new", id_col)).alias("__row"))
    return best.select(*[F.col("__row").getField(c).alias(c) for c in archive.columns])


def coverage(archive: DataFrame, cells: int, cell: str = "cell", fitness: str = "fitness", id_col: str = "ind_id") -> DataFrame:
    """One row: the share of ``cells`` that hold a member, the best fitness, its member."""
    best = F.struct(worst_last(F.col(fitness)), id_col)
    return archive.agg((F.count_distinct(cell) / F.lit(cells)).alias("coverage"), F.min(worst_last(F.col(fitness))).alias("best"), F.min_by(id_col, best).alias("best_id"))


def archive_sample(archive: DataFrame, n: int, cell: str = "cell", seed: int = 0) -> DataFrame:
    """n members drawn with replacement, all cells alike; ``draw`` counts them."""
    return sample_weighted(archive.withColumn("__one", F.lit(1.0)), n, "__one", cell, seed).drop("__one")


def ranked_tournaments(ranked: DataFrame, rounds: int, size: int, id_col: str = "ind_id", seed: int = 0) -> DataFrame:
    """Tournaments by lower rank, of equals by more crowding room."""
    order = F.col("rank") + 1 / (2 + F.col("crowding"))  # ranks are whole; more room takes less than a half
    return tournaments(ranked.withColumn("__order", order), rounds, size, "__order", id_col, seed)


def softmax_elites(pop: DataFrame, n: int, temperature: float = 1.0, fitness: str = "fitness", id_col: str = "ind_id", seed: int = 0) -> DataFrame:
    """n different members, likelier by exp(-fitness / temperature): the largest of -fitness / temperature plus a Gumbel noise of a seeded hash."""
    u = (F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11) + 0.5) / float(1 << 53)
    key = -worst_last(F.col(fitness)) / temperature - F.log(-F.log(u))
    return pop.orderBy(F.desc(key), id_col).limit(n)


def distribution_elite(pop: DataFrame, parent: object, temperature: float = 0.3, fitness: str = "fitness", id_col: str = "ind_id", seed: int = 0) -> DataFrame:
    """One row, the next parent: the best member where one is as good as the parent, of equals the first; else one drawn by exp((f of the parent - f) / temperature).

    The parent takes part in the draw, not in the comparison. Members without a finite fitness are never drawn; where
    the parent has none, the best other member is taken.
    """
    f = worst_last(F.col(fitness))
    others = pop.where(~F.col(id_col).eqNullSafe(F.lit(parent)))
    best = others.agg(F.min_by(id_col, F.struct(f, id_col)).alias("id"), F.min(f).alias("f")).first()
    own = pop.where(F.col(id_col).eqNullSafe(F.lit(parent))).agg(F.min(f)).first()[0]
    own = float("inf") if own is None else own
    if best["id"] is not None and best["f"] <= own:
        return pop.where(F.col(id_col) == F.lit(best["id"])).limit(1)
    weighed = pop.withColumn("__weight", F.exp(-(f - F.lit(own)) / temperature))
    return sample_weighted(weighed, 1, "__weight", id_col, seed).drop("__weight", "draw")


def oversampled(pop: DataFrame, n: int, id_col: str = "ind_id", seed: int = 0) -> DataFrame:
    """pop brought to n rows: every member n // size times, and some, by a seeded hash, once more; ``copy`` counts them."""
    size = pop.count()
    if not size:
        return pop.withColumn("copy", F.lit(0))
    whole, rest = divmod(n, size)
    copies = pop.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(whole)))) if whole else pop.withColumn("copy", F.lit(0)).limit(0)
    more = pop.orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(rest).withColumn("copy", F.lit(whole + 1))
    return copies.unionByName(more)


def fitness_statistics(pop: DataFrame, fitness: str = "fitness", bins: int = 10) -> DataFrame:
    """One row: number, least, mean, deviation and largest of the finite values, and a histogram of equal steps between the ends."""
    finite = pop.where(F.abs(worst_last(F.col(fitness))) != float("inf")).select(F.col(fitness).cast("double").alias("f"))
    ends = finite.agg(F.count("*").alias("n"), F.min("f").alias("least"), F.avg("f").alias("mean"), F.stddev_samp("f").alias("deviation"), F.max("f").alias("largest"))
    place = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col("f") - F.col("least"), F.col("largest") - F.col("least")), F.lit(0.0)) * bins))
    counted = finite.join(F.broadcast(ends.select("least", "largest")), F.lit(True)).agg(*[F.count_if(place == b).alias(f"b{b}") for b in range(bins)])
    return ends.join(counted, F.lit(True)).select("n", "least", "mean", "deviation", "largest", F.array(*[f"b{b}" for b in range(bins)]).alias("histogram"))
