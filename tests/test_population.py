"""Selection over populations against plain Python."""

import random
from collections import Counter

import pytest

from sparkloom.operators import losses, network, population
from sparkloom.plans import program, search
from sparkloom.registry import REGISTRY


@pytest.fixture(scope="module")
def members(spark):
    rng = random.Random(4)
    return [(i, float(rng.randrange(6)), float(rng.randrange(6)), float(rng.randrange(6))) for i in range(120)]


@pytest.fixture(scope="module")
def pop(spark, members):
    return spark.createDataFrame(members, "ind_id long, a double, b double, c double").repartition(5).cache()


def dominates(p, q):
    return all(x <= y for x, y in zip(p, q, strict=True)) and p != q


def test_fronts_of_three_objectives(pop, members):
    got = {r["ind_id"]: r["rank"] for r in population.pareto_ranks(pop, ["a", "b", "c"], fronts=2).collect()}
    first = {m[0] for m in members if not any(dominates(n[1:], m[1:]) for n in members)}
    rest = [m for m in members if m[0] not in first]
    second = {m[0] for m in rest if not any(dominates(n[1:], m[1:]) for n in rest)}
    assert got == dict.fromkeys(first, 1) | dict.fromkeys(second, 2)


def test_crowding_against_sorted_lists(pop, members):
    ranked = population.pareto_ranks(pop, ["a", "b"])
    got = {r["ind_id"]: (r["rank"], r["crowding"]) for r in population.crowding(ranked, ["a", "b"]).collect()}
    for rank in {r for r, _ in got.values()}:
        front = [m for m in members if got[m[0]][0] == rank]
        want = Counter()
        for k in (1, 2):
            line = sorted(front, key=lambda m: (m[k], m[0]))
            width = line[-1][k] - line[0][k]
            for at, m in enumerate(line):
                want[m[0]] += float("inf") if at in (0, len(line) - 1) else (line[at + 1][k] - line[at - 1][k]) / width if width else 0.0
        assert all(abs(got[i][1] - w) < 1e-9 or got[i][1] == w for i, w in want.items())


def test_tournaments_draw_different_members(pop, members):
    fitness = {m[0]: (m[1], m[0]) for m in members}
    drawn = {r["round"]: r["ind_id"] for r in population.tournaments(pop, 200, 3, "a").collect()}
    assert sorted(drawn) == list(range(200)) and len(set(drawn.values())) > 20
    assert {r["round"]: r["ind_id"] for r in population.tournaments(pop.repartition(2), 200, 3, "a").collect()} == drawn
    least = min(fitness, key=fitness.get)
    assert set(r["ind_id"] for r in population.tournaments(pop, 5, 500, "a").collect()) == {least}
    assert set(r["ind_id"] for r in population.tournaments(pop, 5, 119, "a", seed=3).collect()) <= set(sorted(fitness, key=fitness.get)[:2])
    assert population.tournaments(pop.limit(0), 5, 3, "a").count() == 0


def test_nearest_cell_in_blocks(spark):
    rng = random.Random(1)
    points, centres = ([(i, [rng.random(), rng.random()]) for i in range(n)] for n in (50, 40))
    p, c = spark.createDataFrame(points, "ind_id long, descriptor array<double>"), spark.createDataFrame(centres, "cell long, centre array<double>")
    want = {i: min((sum((x - y) ** 2 for x, y in zip(v, w, strict=True)), k) for k, w in centres)[1] for i, v in points}
    for most in (16 << 20, 200):
        assert {r["ind_id"]: r["cell"] for r in population.nearest_cell(p, c, most_bytes=most).collect()} == want


def test_sampling(spark, pop):
    assert population.oversampled(pop, 250).count() == 250 and population.oversampled(pop, 50).count() == 50
    assert Counter(r["count"] for r in population.oversampled(pop, 250).groupBy("ind_id").count().collect()) == {2: 110, 3: 10}
    cold = population.softmax_elites(pop, 5, temperature=1e-3, fitness="a").collect()
    assert len({r["ind_id"] for r in cold}) == 5 and {r["a"] for r in cold} == {0.0}
    weighed = spark.createDataFrame([("x", 1), ("y", 9), ("z", 0)], "behavior string, newness int")
    drawn = Counter(r["behavior"] for r in network.sample_weighted(weighed, 400, "newness", "behavior").collect())
    assert sum(drawn.values()) == 400 and set(drawn) == {"x", "y"} and 330 < drawn["y"] < 390
    assert population.archive_sample(spark.createDataFrame([(i, i) for i in range(9)], "ind_id long, cell long"), 4).count() == 4


def test_elite_by_distribution(spark):
    pop = spark.createDataFrame([(1, 2.0), (2, 1.0), (3, 1.0), (4, 1.5), (5, float("nan")), (6, None)], "ind_id long, fitness double")
    one = lambda df, parent, **how: population.distribution_elite(df, parent, **how).collect()[0]["ind_id"]
    assert one(pop, 4) == 2 == one(pop, 3) and one(pop, 5) == 2
    worse = pop.where("ind_id <> 2")
    drawn = Counter(one(worse, 3, temperature=1.0, seed=k) for k in range(30))
    assert set(drawn) <= {1, 3, 4} and len(drawn) > 1 and drawn[3] >= drawn[1]
    assert one(worse, 3, temperature=1e-3) == 3 == one(pop.where("ind_id = 3"), 3)


def test_tournaments_by_rank_and_room(spark):
    ranked = spark.createDataFrame([(1, 1, 0.5), (2, 1, float("inf")), (3, 2, float("inf"))], "ind_id long, rank int, crowding double")
    assert {r["ind_id"] for r in population.ranked_tournaments(ranked, 4, 3).collect()} == {2}


@pytest.fixture(scope="module")
def arch():
    return program.Architecture((("a", "float"),), ("float",), (0,), nodes=4, registry=REGISTRY.preset("float", families=["scalar"]))


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([(i, float(i), 2.0 * i, float(i * i)) for i in range(12)], "k long, a double, y double, z double")


def test_map_elites_keeps_the_best_of_each_cell(samples, arch):
    archive = search.fit_map_elites(samples, "y", arch, lambda outputs, loss: len(program.steps(outputs)), generations=4, children=6, seed=1)
    assert archive.coverage == sorted(archive.coverage) and archive.history.best == sorted(archive.history.best, reverse=True)
    for cell, (value, genome) in archive.cells.items():
        outputs = program.decode(arch, genome)
        again = losses.score(samples, [outputs[0]], "y")[0]
        assert len(program.steps(outputs)) == cell and (value == again or again is None or again != again)


def test_nsga2_returns_fronts(samples, arch):
    history = search.ObjectiveHistory()
    found = search.fit_nsga2(samples, [("y", losses.absolute), ("z", losses.absolute)], arch, generations=3, size=6, seed=2, history=history)
    assert len(found) == 6 and [r for r, _, _ in found] == sorted(r for r, _, _ in found) and len(history.best) == 3
    for rank, values, _ in found:
        assert (rank == 1) == (not any(dominates(other, values) for _, other, _ in found))
    tables = search.fit_nsga2(samples, [("y", losses.absolute), ("z", losses.absolute)], arch, generations=1, size=4, seed=2, small=0)
    assert len(tables) == 4 and all((r == 1) == (not any(dominates(o, v) for _, o, _ in tables)) for r, v, _ in tables)


@pytest.mark.parametrize("n", [2, 3])
def test_ranks_and_room_on_the_driver_are_those_of_tables(spark, n):
    rng = random.Random(n)
    values = {i: tuple(float(rng.randint(0, 6)) for _ in range(n)) for i in range(40)}
    names = [f"o{k}" for k in range(n)]
    rows = spark.createDataFrame([(i, *v) for i, v in values.items()], ", ".join(["ind_id long", *[f"{k} double" for k in names]]))
    want = {r["ind_id"]: (r["rank"], r["crowding"]) for r in population.crowding(population.pareto_ranks(rows, names), names).collect()}
    got = {m: (r, c) for m, r, c in search.ranked_on_driver(values)}
    assert got.keys() == want.keys() and all(got[m][0] == want[m][0] and got[m][1] == pytest.approx(want[m][1]) for m in got)


def test_hashes_of_programs(samples, arch):
    a, one = program.Input("a", "float"), program.Constant(1.0, "float")
    plus, times = program.call("number_sum", a, one), program.call("number_mult", a, one)
    assert search.phenotype_hash([plus]) != search.phenotype_hash([times]) and search.phenotype_hash([plus]) == search.phenotype_hash([program.call("number_sum", a, one)])
    h = search.behaviour_hashes(samples, [a, times, plus], "k")
    assert h[0] == h[1] != h[2] and search.behaviour_hashes(samples.repartition(3), [a, times, plus], "k") == h
