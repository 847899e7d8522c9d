"""The search network's loop: generations are written as nodes and edges, and the next one is sampled from these tables."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators import losses, network
from ..sources.manifest import Store
from ..sources.tables import new_nodes
from .program import Architecture, Genome, decode, mutate, random_genome
from .search import behaviour_hashes, phenotype_hash

NODES = "id_hash string, genotype string, phenotype string, behavior string, genome string"


@dataclass(frozen=True)
class Generation:
    """What a generation's edges are made of; the population's last member may be the parent."""

    number: int
    losses: Sequence[float]
    ids: Sequence[str]

    @property
    def elite(self) -> int:
        return min(range(len(self.losses)), key=lambda k: (self.losses[k], -k))


#: Properties of edges: a column's type, and its value for each member.
EDGE_PROPERTIES: dict[str, tuple[str, Callable[[Generation], Sequence]]] = {
    "fitness": ("double", lambda g: g.losses),
    "elite": ("double", lambda g: [float(k == g.elite) for k in range(len(g.ids))]),
}


def named(name: str) -> tuple[str, Callable[[Generation], Sequence]]:
    """A property that has the same text on every edge, such as the name of a run."""
    return "string", lambda g: [name] * len(g.ids)


def edge_rows(generation: Generation, parents: Sequence[str], properties: Mapping[str, tuple[str, Callable]] = EDGE_PROPERTIES, except_last: bool = False) -> list[tuple]:
    """(_from, _to, iteration, properties...) from each parent to the member at its place; without the last member if that is the parent itself."""
    columns = [f(generation) for _, f in properties.values()]
    rows = list(zip(parents, generation.ids, [generation.number] * len(generation.ids), *columns, strict=True))
    return rows[:-1] if except_last else rows


def edges_schema(properties: Mapping[str, tuple[str, Callable]] = EDGE_PROPERTIES) -> str:
    return ", ".join(["_from string", "_to string", "iteration long", *[f"{n} {t}" for n, (t, _) in properties.items()]])


@dataclass
class NetworkRun:
    """best: the least loss so far after each generation of this call; store: the tables."""

    store: Store
    best: list[float] = field(default_factory=list)
    evaluations: int = 0
    genome: Genome | None = None


def open_network(spark: SparkSession, path: str, properties: Mapping[str, tuple[str, Callable]] = EDGE_PROPERTIES) -> Store:
    return Store(spark, path, {"nodes": NODES, "edges": edges_schema(properties)})


def _node_rows(samples: DataFrame, key: str, arch: Architecture, genomes: Sequence[Genome]) -> list[tuple]:
    """Nodes with all their hashes; the id is the hash of the others."""
    outputs = [decode(arch, g) for g in genomes]
    seen = behaviour_hashes(samples, [o[0] for o in outputs], key)
    rows = []
    for g, o, b in zip(genomes, outputs, seen, strict=True):
        hashes = (g.key(), phenotype_hash(o), b)
        rows.append((hashlib.sha256("_".join(hashes).encode()).hexdigest(), *hashes, g.dump()))
    return rows


def _population(store: Store, size: int, elites: int, seed: int, rng: random.Random) -> list[tuple[str, Genome]]:
    """The fittest nodes, and the fittest of behaviours drawn by their newness, brought to size by drawing some again."""
    nodes, edges = store.read("nodes"), store.read("edges")
    rows = network.next_population(nodes, edges, min(elites, size), max(size - elites, 1), seed).select("id_hash", "genome").distinct().orderBy("id_hash").collect()
    members = [(r["id_hash"], Genome.load(r["genome"])) for r in rows[:size]]
    return members + [rng.choice(members) for _ in range(size - len(members))]


def fit_network(samples: DataFrame, truth: str, key: str, arch: Architecture, path: str, generations: int = 10, size: int = 10, elites: int = 3, loss: Callable = losses.absolute, changes: int = 1, close: float = 1e-9, seed: int = 0, compact_every: int = 50, properties: Mapping[str, tuple[str, Callable]] = EDGE_PROPERTIES, callbacks: Sequence[Callable[[Generation, Store], None]] = ()) -> NetworkRun:
    """Run up to a number of generations in all, going on where the tables under ``path`` end.

    Every generation samples its parents from the tables (the first one copies one genome), changes each, scores all in
    one Spark job, hashes their behaviour in another, and commits its new nodes and its edges together. What it draws
    depends on the seed and its number alone, so a run that was killed and started again writes the same tables as one
    that wasn't. Every ``compact_every`` generations small files are rewritten. ``key`` tells samples apart.
    Stops when the best loss is about 0. NULL and NaN losses count as infinite.
    """
    spark, store = samples.sparkSession, open_network(samples.sparkSession, path, properties)
    run, scored = NetworkRun(store), samples.cache()
    try:
        if not store.version:
            root = random_genome(arch, random.Random(f"{seed} root"))
            store.append({"nodes": spark.createDataFrame(_node_rows(scored, key, arch, [root]), NODES).coalesce(1)}, {"generation": 0, "seed": seed, "best": None})
        if store.info["seed"] != seed:
            raise ValueError(f"the tables come from seed {store.info['seed']}")
        while store.info["generation"] < generations and not (store.info["best"] is not None and store.info["best"] <= close):
            number = store.info["generation"] + 1
            rng = random.Random(f"{seed} {number}")
            if number == 1:
                row = store.read("nodes").select("id_hash", "genome").first()
                parents = [(row["id_hash"], Genome.load(row["genome"]))] * size
            else:
                parents = _population(store, size, elites, seed * 1_000_003 + number, rng)
            children = [mutate(arch, g, rng, n=changes) for _, g in parents]
            found = losses.score(scored, [decode(arch, g)[0] for g in children], truth, loss)
            values = [float("inf") if x is None or x != x else float(x) for x in found]
            nodes = _node_rows(scored, key, arch, children)
            generation = Generation(number, values, [n[0] for n in nodes])
            for call in callbacks:
                call(generation, store)
            new = new_nodes(store.read("nodes"), spark.createDataFrame(nodes, NODES)).select(*store.read("nodes").columns).coalesce(1)
            edges = spark.createDataFrame(edge_rows(generation, [p for p, _ in parents], properties), edges_schema(properties)).coalesce(1)
            best = min([*values, *([store.info["best"]] if store.info["best"] is not None else [])])
            store.append({"nodes": new, "edges": edges}, {"generation": number, "seed": seed, "best": best if best < float("inf") else None})
            run.evaluations += size
            run.best.append(best)
            if number % compact_every == 0:
                store.compact()
        top = network.top_elites(store.read("nodes"), store.read("edges"), 1).select("genome").first()
        run.genome = Genome.load(top["genome"]) if top else None
    finally:
        scored.unpersist()
    return run
