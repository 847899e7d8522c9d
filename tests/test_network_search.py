"""The search network's loop and tables, racing mutation, fitted constants, draws by weight, losses of many outputs."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import losses, network, population
from sparkloom.plans import constants, network_search, racing, search
from sparkloom.plans.program import Architecture, Constant, Genome, Input, call, decode, project, random_genome
from sparkloom.registry import REGISTRY
from sparkloom.sources.manifest import Conflict, Store

X, Y = Input("x", "float"), Input("y", "float")


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(k, float(k % 7) - 3, float(k % 5), 0.0) for k in range(70)]
    return spark.createDataFrame([(k, x, y, x * y + x) for k, x, y, _ in rows], "k long, x double, y double, t double").cache()


@pytest.fixture(scope="module")
def arch():
    return Architecture((("x", "float"), ("y", "float")), ("float",), (0,), nodes=6, arity=2, registry=REGISTRY.preset("float", families={"scalar"}))


def rows_of(store, table):
    return sorted(map(tuple, store.read(table).collect()), key=str)


def test_a_killed_run_goes_on_as_if_it_had_not_been(spark, samples, arch, tmp_path):
    how = dict(size=5, elites=2, seed=4, close=-1.0, compact_every=2)
    whole = network_search.fit_network(samples, "t", "k", arch, str(tmp_path / "whole"), generations=4, **how)
    assert whole.best == sorted(whole.best, reverse=True) and whole.evaluations == 20

    def killed(generation, store):
        if generation.number == 3:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        network_search.fit_network(samples, "t", "k", arch, str(tmp_path / "cut"), generations=4, callbacks=[killed], **how)
    broken = network_search.open_network(spark, str(tmp_path / "cut"))
    assert broken.info["generation"] == 2
    lost = broken.write("edges", broken.read("edges"))  # a part that was written, but never committed
    again = network_search.fit_network(samples, "t", "k", arch, str(tmp_path / "cut"), generations=4, **how)
    assert again.evaluations == 10 and again.genome == whole.genome
    for table in ("nodes", "edges"):
        assert rows_of(again.store, table) == rows_of(whole.store, table)
    assert f"data/{lost}" in again.store.vacuum() and rows_of(again.store, "edges") == rows_of(whole.store, "edges")
    with pytest.raises(ValueError):
        network_search.fit_network(samples, "t", "k", arch, str(tmp_path / "cut"), generations=5, size=5, seed=5)
    # The tables by SQL: hashes of hashes, edges between known nodes, each generation as large as asked.
    con = duckdb.connect()
    for table in ("nodes", "edges"):
        parts = ", ".join(f"'{tmp_path}/cut/data/{p}/*.parquet'" for p in again.store.parts[table])
        con.execute(f"create view {table} as select * from read_parquet([{parts}])")
    one = lambda q: con.execute(q).fetchone()[0]
    assert one("select count(*) from nodes where id_hash <> sha256(concat_ws('_', genotype, phenotype, behavior))") == 0 == one("select count(*) - count(distinct id_hash) from nodes")
    assert one("select count(*) from edges where _from not in (select id_hash from nodes) or _to not in (select id_hash from nodes)") == 0
    assert con.execute("select iteration, count(*), sum(elite) from edges group by 1 order by 1").fetchall() == [(g, 5, 1.0) for g in range(1, 5)]
    assert one("select min(fitness) from edges") == whole.best[-1]
    for row in rows_of(again.store, "nodes"):
        g = Genome.load(row[4])
        assert row[1] == g.key() and row[2] == search.phenotype_hash(decode(arch, g))
    best = decode(arch, again.genome)
    assert losses.score(samples, best, "t")[0] == pytest.approx(whole.best[-1])


def test_edges_and_their_properties():
    g = network_search.Generation(3, [2.0, 1.0, 1.0], ["a", "b", "c"])
    props = network_search.EDGE_PROPERTIES | {"db": network_search.named("run 1")}
    assert network_search.edge_rows(g, ["p", "p", "q"], props) == [("p", "a", 3, 2.0, 0.0, "run 1"), ("p", "b", 3, 1.0, 0.0, "run 1"), ("q", "c", 3, 1.0, 1.0, "run 1")]
    assert len(network_search.edge_rows(g, ["p", "p", "q"], props, except_last=True)) == 2
    assert network_search.edges_schema(props) == "_from string, _to string, iteration long, fitness double, elite double, db string"


def test_stores_switch_as_a_whole(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path), {"a": "x long", "b": "y string"})
    rows = lambda *v: spark.createDataFrame([(i,) for i in v], "x long")
    assert store.read("a").count() == 0 and store.version == 0
    store.append({"a": rows(1), "b": spark.createDataFrame([("u",)], "y string")}, {"n": 1})
    store.append({"a": rows(2, 3)})
    assert (store.version, store.info, rows_of(store, "a")) == (2, {"n": 1}, [(1,), (2,), (3,)])
    with pytest.raises(ValueError):
        store.write("a", rows(1).withColumnRenamed("x", "z"))
    # Before the switch: the parts are rewritten, then the job is lost.
    old = list(store.parts["a"])
    with monkeypatch.context() as m:
        m.setattr(Store, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.compact()
    fresh = Store(spark, str(tmp_path), store.schemas)
    assert fresh.parts["a"] == old and rows_of(fresh, "a") == [(1,), (2,), (3,)]
    # After it: readers of the old manifest still have their files.
    fresh.compact()
    assert len(fresh.parts["a"]) == 1 and fresh.parts["b"] == store.parts["b"] and rows_of(fresh, "a") == rows_of(store, "a")
    with pytest.raises(Conflict):
        store.append({"a": rows(9)})
    store.refresh()
    assert store.version == 3 and rows_of(store, "a") == [(1,), (2,), (3,)]
    # A manifest that was only written aside counts for nothing.
    (tmp_path / "manifests" / ".half").write_text("{")
    again = Store(spark, str(tmp_path), store.schemas)
    assert again.version == 3 and len(again.vacuum()) >= 4 and rows_of(again, "a") == [(1,), (2,), (3,)] and again.read("b").count() == 1


def test_behaviours(spark, samples):
    a, b = call("number_mult", X, Y), call("number_mult", Y, X)
    h = search.behaviour_hashes(samples, [a, b, call("number_sum", X, Y)], "k")
    assert h[0] == h[1] != h[2] and len(h[0]) == 32
    with pytest.raises(ValueError):
        search.behaviour_hashes(samples.union(samples), [a], "k")


def test_races_read_less_and_find_the_same_winner(spark, samples, arch):
    import sparkloom.plans.program as program

    rng = random.Random(5)
    big = spark.range(4000).select("id", ((F.col("id") % 11) - 5.0).alias("x"), (F.col("id") % 7).cast("double").alias("y")).withColumn("t", F.col("x") * F.col("y") + F.col("x")).cache()
    genome = random_genome(arch, rng)
    drawn = [program.mutate(arch, genome, random.Random(k)) for k in range(24)]
    programs = list(dict.fromkeys(decode(arch, g)[0] for g in drawn))
    parts = racing.slices(big, "id", (0.05, 0.25, 1.0))
    assert sum(p.count() for p in parts) == 4000 and 100 < parts[0].count() < 300
    lanes, alive, rows = racing.race(parts, programs, "t", losses.absolute, [racing.Lane(X) for _ in parts])
    full = [float("inf") if x is None or x != x else x for x in losses.score(big, programs, "t")]
    assert min(alive, key=lambda i: lanes[i].mean) == full.index(min(full)) or min(lanes[i].mean for i in alive) == min(full)
    assert all(lanes[i].mean == pytest.approx(full[i]) for i in alive) and rows < 0.6 * 4000 * (len(programs) + 1)
    with pytest.raises(ValueError):
        racing.slices(big, "id", (0.5, 0.4, 1.0))


def test_racing_mutation(spark, samples, arch):
    rng, seen = random.Random(1), Counter()
    genome = random_genome(arch, rng)
    parent = losses.score(samples, [decode(arch, genome)[0]], "t")[0]
    for _ in range(4):
        out = racing.racing_mutation(samples, "t", "k", arch, genome, rng, seen=seen, candidates=5, tries=3, shares=(0.3, 1.0))
        if not out.raced:  # all that can be drawn was seen
            assert out.genome == genome and out.skipped
            break
        child = losses.score(samples, [decode(arch, out.genome)[0]], "t")[0]
        worst = float("inf")
        value = worst if parent is None or parent != parent else parent
        assert out.parent_loss == pytest.approx(value)
        if out.accepted:
            assert out.loss <= out.parent_loss and out.loss == pytest.approx(child)
            genome, parent = out.genome, child
        else:
            apart = [d for d in out.distances if d > 2.0**-52]
            assert out.genome != genome and (not apart or min(apart) >= 0)
        assert out.raced <= 15 and out.rows > 0
    assert sum(seen.values()) >= 6
    # Phenotypes that were seen don't race again.
    every = Counter({search.phenotype_hash([decode(arch, g)[0]]): 1 for g in [genome]})
    first = racing.racing_mutation(samples, "t", "k", arch, genome, random.Random(3), seen=every, candidates=3, tries=1, shares=(1.0,))
    second = racing.racing_mutation(samples, "t", "k", arch, genome, random.Random(3), seen=every, candidates=3, tries=1, shares=(1.0,))
    assert first.raced == 3 and second.skipped >= 3


def test_constants_of_a_known_formula(spark, samples):
    known = samples.withColumn("t", 2.5 * F.col("x") - 1.5 * F.col("y") + 0.75)
    program, start = constants.free_constants([call("number_sum", call("number_sum", call("number_mult", Constant(1.0, "float"), X), call("number_mult", Constant(0.5, "float"), Y)), Constant(0.0, "float"))])
    assert start == {"k1": 1.0, "k2": 0.5, "k3": 0.0}
    squared = lambda p, t: (p - t) * (p - t)
    found = constants.fit_constants(known.coalesce(1), program[0], start, "t", loss=squared, generations=70, close=1e-9, seed=2)
    assert [found.values[k] for k in start] == pytest.approx([2.5, -1.5, 0.75], abs=1e-3) and found.history == sorted(found.history, reverse=True)
    bound = constants.bind_constants(program, found.values)
    assert project(known, {"p": bound[0]}).select(F.max(F.abs(F.col("p") - F.col("t")))).first()[0] < 0.01


def test_candidates_are_scored_in_one_job_each_like_alone(spark, samples):
    program = call("number_div", Input("k1", "float"), call("number_minus", X, Input("k2", "float")))
    rows = np.array([[1.0, 0.0], [2.0, 10.0], [0.0, -3.0]])
    got = constants.score_candidates(samples.withColumn("k1", F.lit(9.0)), program, ["k1", "k2"], rows, "t")
    want = [losses.score(samples, constants.bind_constants([program], dict(zip(["k1", "k2"], r, strict=True))), "t")[0] for r in rows.tolist()]
    assert got == pytest.approx(want)


def test_cma_on_a_bent_valley():
    cma = constants.Cma([-1.0, 1.5], 0.5, seed=1)
    for _ in range(200):
        c = cma.ask()
        cma.tell(c, 100 * (c[:, 1] - c[:, 0] ** 2) ** 2 + (1 - c[:, 0]) ** 2)
    assert cma.mean == pytest.approx([1.0, 1.0], abs=1e-3)
    for wrong in (lambda: constants.Cma([]), lambda: constants.Cma([1.0], size=1)):
        with pytest.raises(ValueError):
            wrong()


def test_new_constants_take_places():
    program, values = constants.random_constants(call("number_sum", call("number_mult", X, Y), X), 2, random.Random(3))
    assert len(values) == 2 and all(0 <= v < 1 for v in values.values())
    assert sum(i.column in values for i in _inputs(program)) == 2
    with pytest.raises(ValueError):
        constants.random_constants(program, 0, random.Random(3))


def _inputs(node):
    return [node] if isinstance(node, Input) else [i for a in getattr(node, "args", ()) for i in _inputs(a)]


def test_draws_by_weight(spark):
    weights = {i: w for i, w in enumerate([5.0, 0.0, 1.0, 3.0, -2.0, 1.0, None, float("nan"), float("inf"), 10.0])}
    rows = spark.createDataFrame([(i, w, "x" * i) for i, w in weights.items()], "id long, w double, note string").repartition(4)
    got = network.sample_weighted(rows, 20_000, "w", "id", seed=3)
    assert got.columns == ["id", "w", "note", "draw"]
    drawn = got.collect()
    assert sorted(r["draw"] for r in drawn) == list(range(20_000)) and all(r["note"] == "x" * r["id"] for r in drawn)
    counts = Counter(r["id"] for r in drawn)
    assert set(counts) == {0, 2, 3, 5, 9} and all(abs(counts[i] - 1000 * weights[i]) < 5 * (1000 * weights[i]) ** 0.5 for i in counts)
    assert Counter(map(tuple, drawn)) == Counter(map(tuple, network.sample_weighted(rows.repartition(2), 20_000, "w", "id", seed=3).collect()))
    assert network.sample_weighted(rows.where("w < 0"), 5, "w", "id").collect() == [] == network.sample_weighted(rows, 0, "w", "id").collect()
    # No row is made for each draw and row.
    plan = network.sample_weighted(rows, 1000, "w", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "NestedLoop" not in plan and "Join Cross" not in plan
    cells = population.archive_sample(rows, 5000, "id", seed=1).collect()
    assert len(cells) == 5000 and len({r["id"] for r in cells}) == 10 and "__one" not in cells[0].asDict()
    ids = hashlib.sha256(str(sorted(map(str, cells))).encode()).hexdigest()
    assert ids == hashlib.sha256(str(sorted(map(str, population.archive_sample(rows, 5000, "id", seed=1).collect()))).encode()).hexdigest()


def test_losses_of_many_outputs(spark):
    df = spark.createDataFrame([("abc", "x", "abd", "xyz", 1.0, float("nan"), [1.0, 2.0], [3.0])], "a string, b string, c string, d string, n double, m double, v array<double>, w array<double>")
    get = lambda c: df.select(c.alias("x")).first()["x"]
    a, b, c, d, n, m, v, w = (F.col(x) for x in df.columns)
    assert get(losses.levenshtein_many([a, b], [c, d])) == 3.0 and get(losses.levenshtein_many([a], [c, d])) == 1001.0 and get(losses.levenshtein_many([F.lit(None).cast("string"), b], [c, d])) == 1002.0
    assert get(losses.absolute_many([n, m], [n + 2, n])) == 2.0 and get(losses.absolute_many([m], [n])) == 10000.0 and get(losses.absolute_many([n > 0, n], [n * 0, n])) == 1.0
    assert get(losses.vector_many([v, w], [w, w])) == 1002.0 and get(losses.vector_many([F.array(m), w], [w, v])) == 1002.0
    for wrong in (lambda: losses.absolute_many([n], [n, n]), lambda: losses.vector_many([v], [v, w])):
        with pytest.raises(ValueError):
            wrong()
    programs = [[Input("a", "string"), Input("b", "string")], [Input("a", "string")]]
    assert losses.score_many(df, programs, ["c", "d"], losses.levenshtein_many) == [3.0, 1001.0]
