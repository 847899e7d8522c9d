"""Racing mutation: changed programs race their parent over growing shares of the samples, and the slower ones drop out early."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import losses
from .program import Architecture, Genome, Node, decode, mutate, project
from .search import phenotype_hash

#: Steps in which shares of the samples are measured.
STEPS = 10_000


@dataclass
class Lane:
    """What a program has lost so far: the sum over the samples that it met, and their number."""

    program: Node
    total: float = 0.0
    count: int = 0

    @property
    def mean(self) -> float:
        return self.total / self.count if self.count and self.total == self.total else float("inf")


@dataclass
class Race:
    """genome: the winner, or the closest candidate if none is as good as the parent; rows: samples read, counted for each program that read them."""

    genome: Genome
    accepted: bool
    loss: float
    parent_loss: float
    rows: int = 0
    skipped: int = 0
    raced: int = 0
    distances: list[float] = field(default_factory=list)


def run_lanes(samples: DataFrame, lanes: Sequence[Lane], truth: str, loss: Callable) -> int:
    """Let the lanes meet some samples, in one job; gives the samples read, counted for each lane. NULL losses are left out of the mean, NaN makes it infinite."""
    if not lanes:
        return 0
    out = project(samples, {f"__p{i}": lane.program for i, lane in enumerate(lanes)})
    parts = [loss(F.col(f"__p{i}"), F.col(truth)) for i in range(len(lanes))]
    row = out.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(x), F.lit(0.0)).alias(f"s{i}") for i, x in enumerate(parts)], *[F.count(x).alias(f"c{i}") for i, x in enumerate(parts)]).first()
    for i, lane in enumerate(lanes):
        lane.total += row[f"s{i}"]
        lane.count += row[f"c{i}"]
    return row["n"] * len(lanes)


def slices(samples: DataFrame, key: str, shares: Sequence[float], seed: int = 0) -> list[DataFrame]:
    """The samples cut by a seeded hash of their key: the first share of them, what the second adds to it, and so on; the last share is 1."""
    marks = [round(s * STEPS) for s in shares]
    if sorted(set(marks)) != marks or marks[-1] != STEPS or marks[0] < 1:
        raise ValueError("shares grow from above 0 to 1")
    at = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(STEPS))
    return [samples.where((at >= lo) & (at < hi)) for lo, hi in zip([0, *marks], marks, strict=False)]


def race(parts: Sequence[DataFrame], programs: Sequence[Node], truth: str, loss: Callable, parent: Sequence[Lane], keep: float = 0.5) -> tuple[list[Lane], list[int], int]:
    """(lanes, places of those that met all samples, samples read): after each slice but the last the better ``keep`` of the lanes go on, ties of the last one too.

    ``parent`` has a lane for each slice; one that is empty is run along, so a parent reads each slice once in its life.
    """
    lanes, rows = [Lane(p) for p in programs], 0
    alive = list(range(len(lanes)))
    for k, part in enumerate(parts):
        fresh = [] if parent[k].count else [parent[k]]
        rows += run_lanes(part, [*[lanes[i] for i in alive], *fresh], truth, loss)
        if k < len(parts) - 1 and alive:
            ranked = sorted(lanes[i].mean for i in alive)
            limit = ranked[max(1, round(len(alive) * keep)) - 1]
            alive = [i for i in alive if lanes[i].mean <= limit]
    return lanes, alive, rows


def racing_mutation(samples: DataFrame, truth: str, key: str, arch: Architecture, genome: Genome, rng: random.Random, loss: Callable = losses.absolute, changes: int = 1, candidates: int = 8, tries: int = 5, shares: Sequence[float] = (0.05, 0.25, 1.0), seen: Counter | None = None, most_draws: int = 200, keep: float = 0.5) -> Race:
    """Change a genome until a candidate that met all samples loses no more than its parent.

    Each try draws candidates with new material, leaves out those whose phenotype was raced before (``seen`` counts them
    over all races), and races the others. The best of those that are left wins if it is as good as the parent. After
    ``tries`` the candidate closest to the parent's loss without equalling it, over the samples that both met, is taken;
    if all equal it, the last one.
    """
    seen = Counter() if seen is None else seen
    parts = slices(samples, key, shares)
    parent_program = decode(arch, genome)[0]
    parent = [Lane(parent_program) for _ in parts]
    seen[phenotype_hash([parent_program])] += 1
    met: list[tuple[float, Genome, float]] = []
    out = Race(genome, False, float("inf"), float("inf"))
    for _ in range(tries):
        fresh: list[Genome] = []
        for _ in range(most_draws):
            if len(fresh) == candidates:
                break
            child = mutate(arch, genome, rng, n=changes)
            seen[h := phenotype_hash([decode(arch, child)[0]])] += 1
            if seen[h] > 1:
                out.skipped += 1
            else:
                fresh.append(child)
        if not fresh:
            break
        lanes, alive, rows = race(parts, [decode(arch, g)[0] for g in fresh], truth, loss, parent, keep)
        out.rows += rows
        out.raced += len(fresh)
        total = Lane(parent_program, sum(p.total for p in parent), sum(p.count for p in parent))
        out.parent_loss = total.mean
        best = min(alive, key=lambda i: (lanes[i].mean, i))
        if lanes[best].mean <= total.mean:
            out.genome, out.accepted, out.loss = fresh[best], True, lanes[best].mean
            return out
        for i, (lane, g) in enumerate(zip(lanes, fresh, strict=True)):
            # The parent over the slices that the candidate met.
            upto = next((k for k in range(1, len(parts) + 1) if sum(p.count for p in parent[:k]) >= lane.count), len(parts)) if i not in alive else len(parts)
            known = Lane(parent_program, sum(p.total for p in parent[:upto]), sum(p.count for p in parent[:upto]))
            met.append((abs(lane.mean - known.mean) if lane.mean < float("inf") else float("inf"), g, lane.mean))
    out.distances = [d for d, _, _ in met]
    apart = [m for m in met if m[0] > 2.0**-52]
    chosen = min(apart, key=lambda m: m[0]) if apart else met[-1] if met else None
    if chosen:
        out.genome, out.loss = chosen[1], chosen[2]
    return out
