"""The catalogue against plain Python, programs against a row-wise evaluation, the queries against DuckDB."""

import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom import functions, queries
from sparkloom.operators import losses, population
from sparkloom.plans import program, search
from sparkloom.registry import REGISTRY as op
from sparkloom.registry import EngineConf, cast_value
from sparkloom.sources import tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    if isinstance(x, list):
        return F.array(*[F.lit(v) for v in x]) if x else F.array().cast("array<double>")
    return F.lit(x)


# Operator, arguments, result; None where the operation fails.
CASES = [
    ("number_div", (1.0, 0.0), None), ("safe_div", (1.0, 0.0), 0.0), ("modulo", (-7, 3), -1), ("modulo", (7, 0), None), ("power_of", (-8.0, 1 / 3), None), ("relu", (float("nan"),), 0.0), ("relu", (2.0,), 2.0),
    ("experimental_not", (0.5,), 1), ("parse_string", ("true",), True), ("parse_string", ("1+1",), False), ("log_", (0.0,), math.log(1e-10)),
    ("pick_element_from_vector", ([1.0, 2.0], 2), 2.0), ("pick_element_from_vector", ([1.0, 2.0], 3), None), ("pick_element_from_vector", ([1.0, 2.0], 0), None), ("pick_last_element", ([],), None),
    ("find_first", ([3.0, 4.0, 4.0], 4.0), 2), ("find_first", ([3.0], 4.0), 0), ("index_of_first_true", ([0.0, 2.0],), 2), ("index_of_first_true", ([0.0],), -1),
    ("intersect_with_duplicates", ([1.0, 1.0, 2.0], [1.0, 1.0, 1.0]), [1.0, 1.0]), ("left_join", ([1.0, 1.0, 2.0], [1.0]), [1.0, 1.0]),
    ("pick_from_inclusive_generic", ([1.0, 2.0, 3.0], -5), [1.0, 2.0, 3.0]), ("pick_from_exclusive_generic", ([1.0, 2.0, 3.0], 2), [3.0]), ("pick_until_exclusive_generic", ([1.0, 2.0, 3.0], 2), [1.0]), ("pick_until_inclusive_generic", ([1.0], -1), []),
    ("subset_by_mask", ([1.0, 2.0], [0, 3]), [2.0]), ("subset_by_mask", ([1.0, 2.0], [0]), None), ("subset_by_indices", ([5.0, 6.0], [2, 2]), [6.0, 6.0]), ("subset_by_indices", ([5.0], [2]), None),
    ("replace_vec_at", ([1.0, 2.0, 3.0], [9.0, 8.0], [1, 0, 1]), [9.0, 2.0, 8.0]), ("replace_vec_at", ([1.0, 2.0], [9.0], [1, 1]), None),
    ("is_more_than_right", ([3.0, 1.0, 2.0],), [1, 0, 1]), ("is_more_eq_than_right", ([2.0, 2.0],), [1, 1]), ("is_eq_to_prev", ([2.0, 2.0, 1.0],), [0, 1, 0]),
    ("int_divisors", (12,), [1, 2, 3, 4, 6, 12]), ("int_divisors", (16,), [1, 2, 4, 8, 16]), ("int_divisors", (1,), [1]), ("int_divisors", (0,), None),
    ("subtract_vector", ([5.0, 6.0], [1.0]), [4.0, 5.0]), ("sum_vector", ([5.0, 6.0], [1.0]), None), ("div_vector", ([4.0], [0.0]), None), ("recsum", ([1.0, 2.0, 3.0],), [1.0, 3.0, 6.0]), ("recmult", (1.0, 2.0, 3), [1.0, 2.0, 4.0, 8.0]),
    ("range_", (3.7,), [1, 2, 3]), ("range_", (0.0,), []), ("reduce_min", ([],), None), ("reduce_argmax", ([1.0, 7.0, 7.0],), 2),
    ("uppercase_at", ("abc", 9), "abC"), ("uppercase_at", ("", 1), None), ("uppercase_after", ("a-b-c", "-"), "a-B-C"), ("uppercase_before", ("a-b-c", "-"), "A-B-c"), ("uppercase_char_after", ("a-bc-de", "-"), "a-Bc-De"), ("lowercase_char_before", ("AB-CD-E", "-"), "Ab-Cd-E"),
    ("capitalize_all", ("hELLO-wORLD x",), "Hello-World X"), ("if_string", ("s", 0.9), ""), ("replace_pattern", ("ab", "", "-"), "-a-b-"), ("replace_pattern", ("a.b", ".", "x"), "axb"), ("replace_first_pattern", ("aXbX", "X", "yy"), "ayybX"),
    ("split_string_to_vector", ("a.b.", "."), ["a", "b", ""]), ("match_with_overlap", ("aaa", "aa"), [1, 2]), ("number_to_string", (1e7,), "1.0e7"), ("parse_from_list_string", (["1.7", "-1.2"],), [1, -2]), ("parse_from_list_string", (["x"],), None),
]


@pytest.mark.parametrize(("name", "args", "want"), CASES)
def test_operator(spark, name, args, want):
    got = value(spark, op(name, *[lit(a) for a in args]))
    assert got == want or isinstance(want, float) and got is not None and abs(got - want) < 1e-9


def test_casters(spark):
    conf = EngineConf()
    assert [value(spark, cast_value(F.lit(x), "int", conf)) for x in (2.9, -2.1, 5000.0, float("nan"), float("inf"))] == [2, -3, 1000, None, None]
    assert value(spark, cast_value(F.lit(-1e9), "float", conf)) == -1000.0 and math.isnan(value(spark, cast_value(F.lit(float("nan")), "float", conf)))


def test_overloads_and_catalogue(spark):
    assert op.resolve("reduce_length", ["string"]).returns == "int" and op.resolve("is_eq_to", ["list<int>", "int"]).returns == "list<int>"
    with pytest.raises(LookupError):
        op.resolve("number_sum", ["string", "int"])
    assert op.table(spark).count() >= 350


def naive(h, w, p, f):
    return [f(r, c) for c in range(w) for r in range(h)]


def test_images_against_loops(spark):
    h, w = 5, 4
    p = [float((7 * i * i + 3 * i) % 11) / 10 for i in range(h * w)]
    img = functions.images.image(F.lit(h), F.lit(w), "intensity", lit(p))
    at = lambda r, c: p[max(0, min(h - 1, r)) + max(0, min(w - 1, c)) * h]
    get = lambda name, *a: value(spark, op(name, img, *[F.lit(x) for x in a])["pixels"])
    near = lambda r, c: [p[y + x * h] for y in range(h) for x in range(w) if abs(y - r) + abs(x - c) <= 1]
    assert get("erosion_2D", 3.0) == naive(h, w, p, lambda r, c: min(near(r, c))) and get("dilation_2D", 3.0) == naive(h, w, p, lambda r, c: max(near(r, c)))
    kernel = functions.images.DERIVATIVES["sobel"]
    raw = naive(h, w, p, lambda r, c: sum(kernel[i][j] * at(r + i - 1, c + j - 1) for i in range(3) for j in range(3)))
    want = [(x - min(raw)) / (max(raw) - min(raw)) for x in raw]
    assert max(abs(a - b) for a, b in zip(get("sobelx_image2D", 0.0), want, strict=True)) < 1e-9
    block = lambda r, c: [p[y + x * h] for y in range(h) for x in range(w) if y // 2 == r // 2 and x // 2 == c // 2]
    assert get("maxpool_blocks", 2.0) == naive(h, w, p, lambda r, c: max(block(r, c)))
    small = [max(p[y + x * h] for y in (r, r + 1) for x in (c, c + 1)) for c in range(w - 1) for r in range(h - 1)]
    assert get("maxpool", 2.0, 1.0) == [small[r * (h - 1) // h + (c * (w - 1) // w) * (h - 1)] for c in range(w) for r in range(h)]
    number = lambda name, *a: value(spark, op(name, img, *[F.lit(x) for x in a], types=["image"] + ["float"] * len(a)))
    assert number("reduce_nColors") == len(set(p)) and abs(number("region_max", 0.5, 0.5) - max(at(r, c) for r in (1, 2, 3) for c in (1, 2, 3))) < 1e-9
    assert number("orientation_spread") == pytest.approx(1 - number("orientation_coherence"))


def test_masks_keep_columns(spark):
    img = functions.images.image(F.lit(2), F.lit(3), "intensity", lit([0.1, 0.2, 0.3, 0.4, 0.5, 0.6]))
    assert value(spark, op("experimental_notmaskfromtov_image2D", img, F.lit(2), F.lit(3))["pixels"]) == [0.0, 0.0, 0.3, 0.4, 0.5, 0.6]
    assert value(spark, op("experimental_maskfromtoh_image2D", img, F.lit(1), F.lit(1))["pixels"]) == [0.0, 0.2, 0.0, 0.4, 0.0, 0.6]


def test_program_shares_steps_and_renders(spark):
    a, b = program.Input("a", "float"), program.Input("b", "float")
    s = program.call("number_sum", a, b)
    out = program.call("number_mult", s, program.call("number_minus", s, b))
    assert len(program.steps([out, s])) == 3 and program.render([out]).splitlines()[0] == "t1 = number_sum(a, b)"
    df = program.project(spark.createDataFrame([(2.0, 3.0)], "a double, b double"), {"x": out, "y": s})
    assert df.columns == ["a", "b", "x", "y"] and tuple(df.first()) == (2.0, 3.0, 10.0, 5.0)


ARCH = program.Architecture((("a", "float"), ("i", "int")), ("float", "int"), (0,), nodes=6)


def test_genomes_decode_mutate_and_cross():
    rng = random.Random(1)
    for _ in range(30):
        g = program.random_genome(ARCH, rng)
        assert program.Genome.load(g.dump()) == g and len(g.key()) == 64
        child = program.mutate(ARCH, g, rng)
        assert program.decode(ARCH, child)[0].type == "float"
        x, y = program.crossover(g, child, rng)
        assert {x.nodes[0], y.nodes[0]} == {g.nodes[0], child.nodes[0]}


def test_losses(spark):
    assert value(spark, losses.levenshtein(F.lit("kitten"), F.lit("sitting"))) == 3.0 and value(spark, losses.levenshtein(F.lit(None).cast("string"), F.lit("x"))) == 1000.0
    assert value(spark, losses.absolute_sum(lit([1.0, float("nan")]), lit([3.0, 1.0]))) == 2.0 and value(spark, losses.absolute_sum(lit([float("nan")]), lit([1.0]))) == 10000.0
    assert value(spark, losses.vector(lit([1.0, 2.0, 3.0]), lit([2.0]))) == 2001.0


def test_fit_finds_a_sum(spark):
    df = spark.createDataFrame([(float(x), x % 5, float(x)) for x in range(20)], "a double, i long, y double")
    arch = program.Architecture(ARCH.inputs, ("float",), (0,), nodes=3, registry=ARCH.registry.preset("float", families=["scalar"]))
    best, history = search.fit(df, "y", arch, generations=3, children=4, seed=3)
    assert history.best == sorted(history.best, reverse=True) and program.decode(arch, best)[0].type == "float"


def test_selection_and_fronts(spark):
    rng = random.Random(2)
    pop = [(i, float(rng.randrange(8)), float(rng.randrange(8))) for i in range(40)]
    df = spark.createDataFrame(pop, "ind_id long, a double, b double")
    got = {r["ind_id"]: r["rank"] for r in population.pareto_ranks(df, ["a", "b"]).collect()}
    left, rank, want = set(range(40)), 0, {}
    while left:
        rank += 1
        front = {i for i in left if not any(pop[j][1] <= pop[i][1] and pop[j][2] <= pop[i][2] and pop[j][1:] != pop[i][1:] for j in left)}
        want |= dict.fromkeys(front, rank)
        left -= front
    assert got == want
    crowded = population.crowding(population.pareto_ranks(df, ["a", "b"]), ["a", "b"])
    assert population.survivors(crowded, 7).count() == 7
    t = population.tournaments(df, 10, 40, "a").collect()
    assert len(t) == 10 and {r["ind_id"] for r in t} == {min(pop, key=lambda x: (x[1], x[0]))[0]}
    cells = population.nearest_cell(spark.createDataFrame([(1, [0.9, 0.1]), (2, [0.2, 0.1])], "ind_id long, descriptor array<double>"), spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0])], "cell int, centre array<double>"))
    assert {tuple(r) for r in cells.collect()} == {(1, 1), (2, 0)}


def test_tables(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "x"), ("b", "y")], "id_hash string, behavior string")
    nodes.write.parquet(str(tmp_path / "nodes"))
    tables.append_nodes(spark, str(tmp_path / "nodes"), spark.createDataFrame([("b", "z"), ("c", "z"), ("c", "z")], "id_hash string, behavior string"))
    assert Counter(r["id_hash"] for r in spark.read.parquet(str(tmp_path / "nodes")).collect()) == {"a": 1, "b": 1, "c": 1}
    with pytest.raises(ValueError):
        tables.append_edges(str(tmp_path / "edges"), nodes)
    tables.track(nodes, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


def test_the_query_without_sql(spark):
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {"network_search"} and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    rows = queries.QUERIES["network_search"](spark, SF).collect()
    assert Counter(r["iteration"] for r in rows) == {1: 5, 2: 5, 3: 5} and Counter(r["iteration"] for r in rows if r["elite"]) == {1: 1, 2: 1, 3: 1}
    for r in rows:
        assert r["elite"] == 0 or r["fitness"] == min(x["fitness"] for x in rows if x["iteration"] == r["iteration"])
    # Equal programs behave and lose alike.
    for key in ("phenotype", "_to"):
        assert len({(r[key], r["behavior"], r["fitness"]) for r in rows}) == len({r[key] for r in rows})


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    show = lambda rows: Counter(tuple(plain(x) for x in r) for r in rows)
    assert show(got.select(*[f"`{n}`" for n in names]).collect()) == show(cursor.fetchall())


def test_orientation_of_ramps_against_sql(spark, tmp_path):
    """A ramp has pixels of a direction, or none; sums are exact."""
    ramp = [0.0, 0.0, 1.0, 1.0, 2.0, 2.0, 4.0, 4.0]
    spark.createDataFrame([(0, [x for x in ramp for _ in range(8)]), (1, ramp * 8)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    cursor = con.execute(queries.ORACLE_SQL["image_orientation"])
    got = queries.QUERIES["image_orientation"](spark, str(tmp_path)).select(*[d[0] for d in cursor.description]).collect()
    show = lambda rows: sorted(tuple(repr(x + 0.0) for x in r) for r in rows)
    assert show(got) == show(cursor.fetchall()) and sum(math.isnan(r["orientation_select"]) for r in got) == 1
    img = functions.images.image(F.lit(8), F.lit(8), "intensity", lit([x / 4 for x in ramp for _ in range(8)]))
    other = functions.images.image(F.lit(8), F.lit(8), "intensity", lit([x / 4 for x in ramp] * 8))
    assert [0.0] * 64 in [value(spark, op("orientation_select", i)["pixels"]) for i in (img, other)]


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
