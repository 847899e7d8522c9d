"""The generation loop: the driver changes genomes, Spark scores all programs of a generation over all samples."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Hashable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import losses, population
from .program import Architecture, Genome, Node, crossover, decode, mutate, project, random_genome, render


@dataclass
class History:
    best: list[float] = field(default_factory=list)
    evaluations: int = 0


def fit(samples: DataFrame, truth: str, arch: Architecture, generations: int = 10, parents: int = 1, children: int = 8, loss: Callable = losses.absolute, crossing: bool = False, tournament: int = 2, budget: int | None = None, close: float = 1e-9, seed: int = 0, callbacks: tuple[Callable, ...] = ()) -> tuple[Genome, History]:
    """parents + children by truncation: 1 + n for one parent, a genetic algorithm with tournaments for more.

    Stops when the best loss is about 0 or the budget of evaluations is used. Later individuals win ties.
    """
    rng = random.Random(seed)
    scored = samples.cache()
    worst = float("inf")
    value = lambda x: worst if x is None or x != x else x
    pop = [(worst, random_genome(arch, rng)) for _ in range(parents + children)]
    history = History()
    fresh = pop
    elite: list[tuple[float, Genome]] = []
    for generation in range(generations):
        found = losses.score(scored, [decode(arch, g)[0] for _, g in fresh], truth, loss)
        history.evaluations += len(fresh)
        ranked = sorted(enumerate([*elite, *[(value(x), g) for x, (_, g) in zip(found, fresh, strict=True)]]), key=lambda x: (x[1][0], -x[0]))
        elite = [x for _, x in ranked[:parents]]
        history.best.append(elite[0][0])
        for call in callbacks:
            call(generation, elite, history)
        if elite[0][0] <= close or budget is not None and history.evaluations >= budget:
            break
        pick = lambda among: min(rng.sample(among, min(tournament, len(among))), key=lambda x: x[0])
        fresh = []
        for _ in range(children):
            chosen = pick(elite)
            child = chosen[1]
            if crossing and len(elite) > 1:  # with a different member
                child = crossover(child, pick([x for x in elite if x is not chosen])[1], rng)[0]
            fresh.append((worst, mutate(arch, child, rng)))
    scored.unpersist()
    return elite[0][1], history


def phenotype_hash(outputs: Sequence[Node]) -> str:
    """Equal for programs that are written alike, whatever genes are inactive."""
    return hashlib.sha256(render(outputs).encode()).hexdigest()


def behaviour_hashes(samples: DataFrame, programs: Sequence[Node], key: str) -> list[str]:
    """For each program a hash of its outputs on all samples; key tells samples apart, and one that repeats is refused.

    Two sums of row hashes of different seeds, modulo 2 to the 64: one job, with partial sums, whatever the rows' order.
    """
    out = project(samples, {f"__p{i}": p for i, p in enumerate(programs)})
    row_hash = lambda i, seed: F.xxhash64(F.lit(seed), F.col(key), F.coalesce(F.col(f"__p{i}").cast("string"), F.lit("\0null"))).cast("decimal(38,0)")
    sums = [F.coalesce(F.sum(row_hash(i, s)), F.lit(0)).alias(f"h{i}_{s}") for i in range(len(programs)) for s in (1, 2)]
    row = out.agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys"), *sums).first()
    if row["n"] != row["keys"]:
        raise ValueError(f"{key} doesn't tell samples apart")
    return ["".join(f"{int(row[f'h{i}_{s}']) % 2**64:016x}" for s in (1, 2)) for i in range(len(programs))]


@dataclass
class ObjectiveHistory:
    """Of each generation the best loss of every objective, and how many members no other dominates."""

    best: list[tuple[float, ...]] = field(default_factory=list)
    front: list[int] = field(default_factory=list)

    def add(self, losses_: Sequence[tuple[float, ...]]) -> None:
        below = lambda a, b: all(x <= y for x, y in zip(a, b, strict=True)) and a != b
        self.best.append(tuple(map(min, zip(*losses_, strict=True))))
        self.front.append(sum(not any(below(o, v) for o in losses_) for v in losses_))


@dataclass
class Archive:
    """The best genome of each cell."""

    cells: dict[Hashable, tuple[float, Genome]] = field(default_factory=dict)
    history: History = field(default_factory=History)
    coverage: list[int] = field(default_factory=list)


def fit_map_elites(samples: DataFrame, truth: str, arch: Architecture, cell_of: Callable[[Sequence[Node], float], Hashable], generations: int = 10, children: int = 8, loss: Callable = losses.absolute, close: float = 1e-9, seed: int = 0) -> Archive:
    """MAP-Elites: children of members drawn from all cells, scored in one job a generation; a cell keeps its best, of equals the newest.

    cell_of gives the cell of a program (its outputs, its loss). NULL and NaN losses count as infinite.
    """
    rng, archive, scored = random.Random(seed), Archive(), samples.cache()
    fresh = [random_genome(arch, rng) for _ in range(children)]
    for _ in range(generations):
        outputs = [decode(arch, g) for g in fresh]
        found = losses.score(scored, [o[0] for o in outputs], truth, loss)
        archive.history.evaluations += len(fresh)
        for genome, nodes, x in zip(fresh, outputs, found, strict=True):
            value = float("inf") if x is None or x != x else x
            cell = cell_of(nodes, value)
            if cell not in archive.cells or value <= archive.cells[cell][0]:
                archive.cells[cell] = (value, genome)
        archive.history.best.append(min(x for x, _ in archive.cells.values()))
        archive.coverage.append(len(archive.cells))
        if archive.history.best[-1] <= close:
            break
        members = [g for _, g in archive.cells.values()]
        fresh = [mutate(arch, rng.choice(members), rng) for _ in range(children)]
    scored.unpersist()
    return archive


#: Members up to which a population is ranked on the driver; a larger one is a table.
SMALL = 1000


def ranked_on_driver(values: dict[int, tuple[float, ...]]) -> list[tuple[int, int, float]]:
    """(member, rank, crowding), as operators.population gives them, for a population of at most some thousands."""
    ids = sorted(values)
    points = np.array([values[i] for i in ids], float)
    beaten = (points[:, None] <= points[None, :]).all(axis=2) & (points[:, None] < points[None, :]).any(axis=2)
    ranks, left, rank = np.zeros(len(ids), int), np.ones(len(ids), bool), 0
    while left.any():
        rank += 1
        front = left & ~beaten[left].any(axis=0)
        ranks[front] = rank
        left &= ~front
    room = np.zeros(len(ids))
    for r in range(1, rank + 1):
        front = np.flatnonzero(ranks == r)
        for k in range(points.shape[1]):
            order = front[np.lexsort((front, points[front, k]))]
            v = points[order, k]
            width = v[-1] - v[0]
            with np.errstate(invalid="ignore"):
                gaps = np.concatenate([[np.inf], (v[2:] - v[:-2]) / width if width else np.zeros(max(len(v) - 2, 0)), [np.inf]])[: len(v)]
            room[order] += gaps
    return [(i, int(r), float(c)) for i, r, c in zip(ids, ranks, room, strict=True)]


def fit_nsga2(samples: DataFrame, objectives: Sequence[tuple[str, Callable]], arch: Architecture, generations: int = 5, size: int = 8, tournament: int = 2, seed: int = 0, history: ObjectiveHistory | None = None, small: int = SMALL) -> list[tuple[int, tuple[float, ...], Genome]]:
    """NSGA-II over several losses, (column of the truth, loss) each: (rank, losses, genome) of the last population, best first.

    A population whose parents and children are at most ``small`` is ranked and drawn from on the driver; fronts, crowding,
    tournaments and survival of a larger one are those of ``operators.population``, over tables of a row a member. Only
    the members of the generation are kept. NULL and NaN losses count as infinite.
    """
    rng, scored, spark = random.Random(seed), samples.cache(), samples.sparkSession
    names = [f"o{k}" for k in range(len(objectives))]
    known: dict[int, tuple[tuple[float, ...], Genome]] = {}
    born = 0

    def add(genomes: list[Genome]) -> list[int]:
        nonlocal born
        programs = [decode(arch, g)[0] for g in genomes]
        found = [losses.score(scored, programs, truth, loss) for truth, loss in objectives]
        new = list(range(born, born + len(genomes)))
        for i, genome, values in zip(new, genomes, zip(*found, strict=True), strict=True):
            known[i] = (tuple(float("inf") if x is None or x != x else float(x) for x in values), genome)
        born += len(genomes)
        return new

    def ranked(members: list[int]) -> list[tuple[int, int, float]] | DataFrame:
        if 2 * size <= small:
            return ranked_on_driver({m: known[m][0] for m in members})
        rows = spark.createDataFrame([(m, *known[m][0]) for m in members], ", ".join(["ind_id long", *[f"{n} double" for n in names]]))
        return population.crowding(population.pareto_ranks(rows, names), names)

    def drawn(of: list | DataFrame, rounds: int, at: int) -> list[int]:
        if isinstance(of, DataFrame):
            return [r["ind_id"] for r in population.ranked_tournaments(of, rounds, tournament, seed=seed + at).orderBy("round").collect()]
        best = lambda some: min(some, key=lambda m: (m[1], -m[2], m[0]))[0]
        return [best(rng.sample(of, min(tournament, len(of)))) for _ in range(rounds)]

    def kept(of: list | DataFrame) -> list[int]:
        if isinstance(of, DataFrame):
            return [r["ind_id"] for r in population.survivors(of, size).collect()]
        return [m[0] for m in sorted(of, key=lambda m: (m[1], -m[2], m[0]))[:size]]

    members = add([random_genome(arch, rng) for _ in range(size)])
    for generation in range(generations):
        chosen = drawn(ranked(members), 2 * size, generation)
        new = add([mutate(arch, crossover(known[a][1], known[b][1], rng)[0], rng) for a, b in zip(chosen[::2], chosen[1::2], strict=True)])
        members = kept(ranked([*members, *new]))
        known = {m: known[m] for m in members}
        if history is not None:
            history.add([known[m][0] for m in members])
    last = ranked(members)
    rows = [(r["ind_id"], r["rank"]) for r in last.orderBy("rank", "ind_id").collect()] if isinstance(last, DataFrame) else sorted(((m, r) for m, r, _ in last), key=lambda x: (x[1], x[0]))
    scored.unpersist()
    return [(r, *known[m]) for m, r in rows]
