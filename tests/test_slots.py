"""Slots, parts of programs as operators, and the store of definitions."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.plans import parts, slots
from sparkloom.plans.program import Architecture, Constant, Input, Sharing, call, decode, dump_nodes, load_nodes, project, random_genome, render, steps
from sparkloom.plans.slots import SlotError, Slots
from sparkloom.program_queries import _price_slots, _profit, slot_genome
from sparkloom.registry import REGISTRY
from sparkloom.sources import programs

X, Y = Input("x", "float"), Input("y", "float")


def test_reserved_slots_are_the_identity_and_keep_their_names(spark):
    made = Slots()
    assert made.reserve("float", 2) == ["adf_1", "adf_2"] and made.reserve("list<float>", 1) == ["adf_3"] and made.reserve("float", 0) == []
    assert "adf_1" not in REGISTRY.ops and made.slots["adf_1"].empty
    twice = call("adf_2", call("adf_1", X, registry=made.registry), registry=made.registry)
    assert made.expand([twice]) == [X]
    df = spark.createDataFrame([(2.5, 1.0)], "x double, y double")
    assert df.select(made.registry("adf_1", F.col("x"))).first()[0] == 2.5
    made.put("adf_1", call("number_sum", call("number_sum", X, Y), Y), [X, Y], "sum")
    assert made.slots["adf_1"].params == ("float", "float") and made.slots["adf_1"].source() == "t1 = number_sum(in1, in2)\nt2 = number_sum(t1, in2)\nout1 = t2"
    assert df.select(made.registry("adf_1", F.col("x"), F.col("y"))).first()[0] == 4.5
    # Extra arguments are left out, missing ones refused.
    assert made.registry.resolve("adf_1", ["float", "float", "string"]).name == "adf_1"
    for types in (["float"], ["float", "string"]):
        with pytest.raises(LookupError):
            made.registry.resolve("adf_1", types)


def test_what_is_refused():
    made = Slots()
    made.reserve("float", 3)
    own = lambda op, *a: call(op, *a, registry=made.registry)
    made.put("adf_1", own("number_sum", X, Y), [X, Y])
    made.put("adf_2", own("number_mult", own("adf_1", X, Y), Y), [X, Y])
    program = own("number_sum", own("adf_3", X), X)
    made.define("fixed", own("number_sum", X, X), [X])
    for name, body, inputs, population in (
        ("adf_9", X, [X], ()),  # not reserved
        ("adf_1", own("number_mult", X, Y), [X, Y], ()),  # adf_2 uses it
        ("adf_3", own("adf_3", X), [X], ()),  # calls itself
        ("adf_3", own("number_sum", X, Y), [X], ()),  # an input isn't named
        ("adf_3", own("number_sum", X, X), [X, X], ()),  # named twice
        ("adf_3", Constant(1.0, "float"), [], ()),  # none
        ("adf_3", own("split_string_to_vector", Input("s", "string"), Input("t", "string")), [Input("s", "string"), Input("t", "string")], ()),  # another type
        ("adf_3", own("number_sum", X, Y), [X, Y], [[program]]),  # an individual uses it
        ("fixed", own("number_mult", X, X), [X], ()),
        ("number_sum", X, [X], ()),
    ):
        with pytest.raises(SlotError):
            made.put(name, body, inputs, population=population)
    # A cycle over two slots: adf_2 is free, but adf_3 calls it.
    made.put("adf_3", own("adf_2", X, Y), [X, Y])
    with pytest.raises(SlotError):
        made.put("adf_2", own("adf_3", X, Y), [X, Y])
    assert made.closure("adf_3") == {"adf_1", "adf_2"} and made.users("adf_1") == {"adf_2", "adf_3"} and made.replaceable("adf_3") and not made.replaceable("adf_3", [[program]])
    assert [s.name for s in made.in_order()] == ["adf_1", "adf_2", "adf_3", "fixed"] and made.used([program]) == {"adf_3"}


def test_expansion_shares_equal_calls_at_every_depth(spark):
    made = Slots()
    names = made.reserve("float", 41)
    own = lambda op, *a: call(op, *a, registry=made.registry)
    made.put(names[0], own("number_mult", X, Constant(0.5, "float")), [X])
    for a, b in zip(names, names[1:], strict=False):  # a tree of 2 ** 40 calls
        made.put(b, own("number_sum", own(a, X), own(a, X)), [X])
    program = made.expand([own(names[-1], X)])
    assert len(steps(program)) == 41 and len(render(program).split("\n")) == 42
    assert load_nodes(dump_nodes(program)) == program
    df = spark.createDataFrame([(3.0,)], "x double")
    assert made.project(df, {"out": own(names[12], X)}).first()["out"] == 3.0 * 2**11
    levels = [len(steps(made.expand([own(names[3], X)], depth=d))) for d in range(6)]
    assert levels[0] == 1 and levels == sorted(levels) and levels[4] == levels[5] == 4


def random_arch(registry):
    return Architecture((("x", "float"), ("y", "float")), ("float",), (0, 0), nodes=8, arity=3, registry=registry)


def test_flattened_genomes_decode_to_the_expanded_programs():
    base = REGISTRY.preset("float", families={"scalar"})
    flattened = 0
    for seed in range(60):
        rng = random.Random(seed)
        made = Slots(base)
        made.reserve("float", 6)
        own = lambda op, *a: call(op, *a, registry=made.registry)  # noqa: B023, E731
        made.put("adf_1", own("number_sum", own("number_mult", X, Y), X), [X, Y])
        made.put("adf_2", own("adf_1", own("exp_", X), own("adf_1", X, X)), [X])
        made.put("adf_3", X, [X, Y])
        arch = random_arch(made.registry)
        genome = random_genome(arch, rng)
        programs_ = decode(arch, genome)
        wide, flat = made.flatten(arch, genome)
        assert decode(wide, flat) == made.expand(programs_) and not made.used(decode(wide, flat))
        assert all(len(c) == wide.nodes for c in flat.nodes)
        flattened += bool(made.used(programs_))
        one, step = made.flatten(arch, genome, depth=1)
        assert made.expand(decode(one, step)) == made.expand(programs_)
    assert flattened > 20


def test_slots_from_genomes():
    made, arch, genome = slot_genome()
    wide, flat = made.flatten(arch, genome)
    assert wide.nodes == 7 and "adf" not in render(decode(wide, flat))
    other = Slots(REGISTRY.preset("float"))
    other.reserve("float", 1)
    slot = other.put_genome("adf_1", wide, flat)
    assert slot.params == ("float",) * 5
    args = [Input(*i) for i in wide.inputs]
    assert other.expand([call("adf_1", *args, registry=other.registry)]) == decode(wide, flat)
    with pytest.raises(SlotError):
        other.reserve("float", 1)
        other.put_genome("adf_2", random_arch(other.registry), random_genome(random_arch(other.registry), random.Random(1)))


def test_parts_are_convex_and_give_the_program_back():
    whole, sizes = _profit(), set()
    shared = Sharing().rebuild([whole, call("exp_", whole)])
    for seed in range(300):
        part = parts.select_part(shared, random.Random(seed), most_inputs=3)
        if part is None:
            continue
        sizes.add(part.size)
        assert 1 <= len(part.inputs) <= 3 and part.size >= 2 and len(part.args) == len(part.inputs)
        made = Slots()
        made.define("part", part.body, part.inputs)
        cut = parts.cut_out(shared, part, "part")
        assert made.used(cut) == {"part"} and made.expand(cut) == shared
        # Convex: no argument of the part is worked out from one of its calls.
        body = {c.op for c in steps([part.body])}
        end = {id(c) for c in steps([part.end])}
        for a in part.args:
            inner = steps([a])
            assert part.end not in inner and all(id(c) in end for c in inner) and body
    assert len(sizes) > 3
    assert parts.select_part(shared, random.Random(0), most_inputs=0) is None and parts.select_part([X], random.Random(0)) is None
    assert all(p is None or p.end.type == "float" for p in [parts.select_part(shared, random.Random(s), returns="float") for s in range(20)]) and parts.select_part(shared, random.Random(0), returns="string") is None


def test_programs_with_parts_compile_to_equal_columns(spark):
    df = spark.createDataFrame([(10.0, 0.1, 0.2, 3.0), (7.5, 0.0, 0.0, 2.0)], "l_extendedprice double, l_discount double, l_tax double, l_quantity double")
    want = [r["w"] for r in project(df, {"w": _profit()}).collect()]
    for seed in range(6):
        made = Slots()
        left = parts.modularise(made, [_profit()], random.Random(seed), "m", most_inputs=4)
        assert [r["w"] for r in made.project(df, {"w": left[0]}).collect()] == want == [r["w"] for r in project(df, {"w": left[0]}, made.registry).collect()]


def test_store_of_definitions(spark, tmp_path):
    path, made = str(tmp_path / "store"), _price_slots()
    assert programs.save(spark, made, path, "a") == {"adf_1": 1, "adf_2": 1, "adf_3": 1, "adf_4": 1} == programs.save(spark, made, path, "a")
    assert programs.definitions(spark, path).count() == 4
    own = lambda op, *a: call(op, *a, registry=made.registry)
    best = [own("adf_3", *[Input(c, "float") for c in ("p", "d", "t")])]
    programs.save_individual(spark, made, path, "a", "best", best)
    loaded = programs.load(spark, path, "a")
    assert loaded.expand(best) == made.expand(best) and loaded.slots == made.slots
    # A changed slot gets a version, and so does what calls it; the individual keeps the old ones.
    changed = slots.Slots()
    changed.reserve("float", 4)
    changed.put("adf_1", call("number_sum", X, Y), [X, Y], "net")
    theirs = lambda op, *a: call(op, *a, registry=changed.registry)
    changed.put("adf_2", theirs("number_mult", theirs("adf_1", X, Y), Y), [X, Y, Input("z", "float")], "charge")
    assert programs.save(spark, changed, path, "a") == {"adf_1": 2, "adf_2": 2, "adf_3": 2, "adf_4": 1}
    outputs, old = programs.load_individual(spark, path, "a", "best")
    assert outputs == best and old.expand(outputs) == made.expand(best) and set(old.slots) == {"adf_3", "adf_1@1", "adf_2@1"}
    mixed = programs.load(spark, path, "a", {"adf_1": 2, "adf_2": 1})
    assert set(mixed.slots) == {"adf_1", "adf_2", "adf_1@1"} and mixed.dependencies("adf_2") == {"adf_1@1"} and mixed.slots["adf_1@1"].fixed
    # Environments are apart.
    assert programs.save(spark, changed, path, "b")["adf_1"] == 1
    for wrong in (lambda: programs.load(spark, path, "a", {"adf_1": 7}), lambda: programs.load_individual(spark, path, "a", "none"), lambda: programs.save_individual(spark, made, path, "c", "x", best), lambda: programs.save_individual(spark, made, path, "b", "x", best)):
        with pytest.raises(programs.UnknownDependency):
            wrong()
    assert programs.missing_dependencies(spark, path).collect() == []
    lost = spark.createDataFrame([("a", "adf_8", 1, "", ["float"], "float", dump_nodes([X]), False, [("adf_7", 3)], "")], programs.DEFINITIONS)
    lost.write.mode("append").parquet(f"{path}/definitions")
    assert [tuple(r) for r in programs.missing_dependencies(spark, path).collect()] == [("a", "adf_7", 3)]
    with pytest.raises(programs.UnknownDependency):
        programs.load(spark, path, "a")
