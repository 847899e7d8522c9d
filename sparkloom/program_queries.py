"""Queries of programs that call sub-programs: slots, flattened genomes, parts cut out as operators, the store of definitions; and their SQL."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import losses
from .plans import constants, parts, slots
from .plans.network_search import fit_network
from .plans.program import Architecture, Constant, Genome, Input, Node, call, decode, project
from .registry import REGISTRY
from .sources import programs
from .sources.tables import new_folder

_PRICE, _DISCOUNT, _TAX, _QUANTITY = (Input(c, "float") for c in ("l_extendedprice", "l_discount", "l_tax", "l_quantity"))
_ONE = Constant(1.0, "float")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _price_slots() -> slots.Slots:
    """adf_1: a price less a discount; adf_2: that with a tax, by adf_1; adf_3: the tax alone, by both; adf_4: still empty."""
    made = slots.Slots()
    made.reserve("float", 4)
    own = lambda op, *args: call(op, *args, registry=made.registry)
    made.put("adf_1", own("number_mult", _PRICE, own("number_minus", _ONE, _DISCOUNT)), [_PRICE, _DISCOUNT], "net")
    made.put("adf_2", own("number_mult", own("adf_1", _PRICE, _DISCOUNT), own("number_sum", _ONE, _TAX)), [_PRICE, _DISCOUNT, _TAX], "charge")
    made.put("adf_3", own("number_minus", own("adf_2", _PRICE, _DISCOUNT, _TAX), own("adf_1", _PRICE, _DISCOUNT)), [_PRICE, _DISCOUNT, _TAX], "due")
    return made


def slot_calls(spark, sf_dir):
    """Programs that call nested slots, an empty one among them; equal calls inside them are worked out once."""
    made = _price_slots()
    own = lambda op, *args: call(op, *args, registry=made.registry)
    each = own("number_div", own("adf_2", own("adf_4", _PRICE), _DISCOUNT, _TAX), _QUANTITY)
    outputs = {"net": own("adf_1", _PRICE, _DISCOUNT), "charge": own("adf_2", _PRICE, _DISCOUNT, _TAX), "due": own("adf_3", _PRICE, _DISCOUNT, _TAX), "each": each}
    return made.project(_lines(spark, sf_dir), outputs).select("l_orderkey", "l_linenumber", *outputs)


def slot_genome() -> tuple[slots.Slots, Architecture, Genome]:
    """A genome whose active genes call slots: out = charge(price, discount, tax) / quantity, with genes that nothing reaches."""
    made = slots.Slots(REGISTRY.preset("float"))
    made.reserve("float", 2)
    own = lambda op, *args: call(op, *args, registry=made.registry)
    one = Input("one", "float")
    made.put("adf_1", own("number_mult", _PRICE, own("number_minus", one, _DISCOUNT)), [_PRICE, _DISCOUNT, one], "net")
    made.put("adf_2", own("number_mult", own("adf_1", _PRICE, _DISCOUNT, one), own("number_sum", one, _TAX)), [_PRICE, _DISCOUNT, _TAX, one], "charge")
    arch = Architecture((("l_extendedprice", "float"), ("l_discount", "float"), ("l_tax", "float"), ("l_quantity", "float"), ("one", "float")), ("float",), (0,), nodes=4, arity=4, registry=made.registry)
    at = {s.name: k for k, s in reversed(list(enumerate(arch.operators("float"))))}
    gene = lambda op, *args: (at[op], *[(a, 0) for a in (*args, *[0] * 4)[:4]])
    genes = (gene("power_of", 0, 1), gene("adf_2", 0, 1, 2, 4), gene("number_div", 6, 3), gene("exp_", 6))
    return made, arch, Genome((genes,), (7,))


def slot_flattened(spark, sf_dir):
    """The genome with its slots expanded in the program, and written into a wider genome without slots."""
    made, arch, genome = slot_genome()
    wide, flat = made.flatten(arch, genome)
    lines = _lines(spark, sf_dir).withColumn("one", F.lit(1.0))
    called = made.project(lines, {"called": decode(arch, genome)[0]})
    return project(called, {"flat": decode(wide, flat)[0]}).select("l_orderkey", "l_linenumber", "called", "flat")


def _profit() -> Node:
    net = call("number_mult", _PRICE, call("number_minus", _ONE, _DISCOUNT))
    charge = call("number_mult", net, call("number_sum", _ONE, _TAX))
    return call("number_div", call("number_minus", call("number_sum", charge, net), call("number_mult", _DISCOUNT, charge)), _QUANTITY)


def part_calls(spark, sf_dir):
    """One program, and four in which random parts of it are operators of their own, cut one after the other."""
    whole, outputs = _profit(), {}
    made = slots.Slots()
    for seed in range(4):
        left = [whole]
        for k in range(2):
            left = parts.modularise(made, left, random.Random(10 * seed + k), f"part_{seed}_{k}", most_inputs=4, attempts=50)
        outputs[f"p{seed}"] = left[0]
    return made.project(_lines(spark, sf_dir), {"whole": whole, **outputs}).select("l_orderkey", "l_linenumber", "whole", *outputs)


def stored_slots(spark, sf_dir):
    """Slots saved, replaced and saved again: the individual keeps the versions that it was saved with."""
    path = new_folder(spark, "programs")
    made = _price_slots()
    own = lambda op, *args: call(op, *args, registry=made.registry)
    before = own("number_sum", own("adf_2", _PRICE, _DISCOUNT, _TAX), own("adf_1", _PRICE, _DISCOUNT))
    programs.save(spark, made, path, "first")
    programs.save_individual(spark, made, path, "first", "best", [before])
    later = slots.Slots()
    later.reserve("float", 4)
    later.put("adf_1", call("number_mult", _PRICE, _DISCOUNT), [_PRICE, _DISCOUNT], "rebate")
    programs.save(spark, later, path, "first")
    outputs, old = programs.load_individual(spark, path, "first", "best")
    new = programs.load(spark, path, "first")
    shown = old.project(_lines(spark, sf_dir), {"before": outputs[0]})
    return new.project(shown, {"after": call("adf_1", _PRICE, _DISCOUNT, registry=new.registry)}).select("l_orderkey", "l_linenumber", "before", "after")


def loss_many(spark, sf_dir):
    """Losses over two outputs, of texts, numbers and lists; one with an output too few."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    name, kind, brand, size, price = (F.col(c) for c in ("p_name", "p_type", "p_brand", "p_size", "p_retailprice"))
    digits = lambda x, n: F.transform(F.sequence(F.lit(1), n), lambda i: (x + i).cast("double"))
    text = losses.levenshtein_many([name, kind], [kind, brand])
    short = losses.levenshtein_many([name], [kind, brand])
    numbers = losses.absolute_many([size, F.when(size % 3 == 0, F.lit(float("nan"))).otherwise(price)], [size + 1, price / 2])
    lists = losses.vector_many([digits(size, size % 5 + 1), digits(size, F.lit(2))], [digits(size * 2, size % 3 + 1), digits(price, F.lit(2))])
    return p.select("p_partkey", text.alias("texts"), short.alias("short"), F.round(numbers, 6).alias("numbers"), F.round(lists, 6).alias("lists"))


def fitted_line(spark, sf_dir):
    """Slope and intercept of the mean price over each quantity, as constants of a program fitted to the least squared loss."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_quantity").agg(F.avg("l_extendedprice").alias("p"))
    p = lines.select(((F.col("l_quantity") - 25.5) / 15).alias("x"), (F.col("p") / 10000 - 5).alias("y")).coalesce(1)
    line = call("number_sum", call("number_mult", Input("slope", "float"), Input("x", "float")), Input("shift", "float"))
    found = constants.fit_constants(p, line, {"slope": 0.0, "shift": 0.0}, "y", loss=lambda pred, truth: (pred - truth) * (pred - truth), generations=35, size=8, seed=1)
    return spark.createDataFrame([tuple(round(found.values[k], 3) + 0.0 for k in ("slope", "shift"))], "slope double, shift double")


def network_search(spark, sf_dir):
    """Three generations of the search network over lists of quantities: its edges, with the behaviour that each reached."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_quantity")).alias("v"), (F.avg("l_extendedprice") / 1000).alias("y"))
    arch = Architecture((("v", "list<float>"),), ("list<float>", "float"), (1,), nodes=6, arity=2, registry=REGISTRY.preset("float", families={"lists"}))
    arch.registry.ops |= REGISTRY.preset("list<float>", families={"lists"}).ops
    run = fit_network(lines, "y", "l_orderkey", arch, new_folder(spark, "network"), generations=3, size=5, elites=2, seed=3)
    nodes = run.store.read("nodes").select(F.col("id_hash").alias("_to"), "behavior", "phenotype")
    return run.store.read("edges").join(nodes, "_to").select("_from", "_to", "iteration", "fitness", "elite", "behavior", "phenotype")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (slot_calls, slot_flattened, part_calls, stored_slots, loss_many, fitted_line, network_search)}

_NET = "l_extendedprice * (1 - l_discount)"
_WHOLE = f"({_NET} * (1 + l_tax) + {_NET} - l_discount * ({_NET} * (1 + l_tax))) / l_quantity"

ORACLE_SQL: dict[str, str] = {
    "slot_calls": f"select l_orderkey, l_linenumber, {_NET} as net, {_NET} * (1 + l_tax) as charge, {_NET} * (1 + l_tax) - {_NET} as due, {_NET} * (1 + l_tax) / l_quantity as each from lineitem",
    "slot_flattened": f"select l_orderkey, l_linenumber, {_NET} * (1 + l_tax) / l_quantity as called, {_NET} * (1 + l_tax) / l_quantity as flat from lineitem",
    "part_calls": f"select l_orderkey, l_linenumber, {_WHOLE} as whole, {_WHOLE} as p0, {_WHOLE} as p1, {_WHOLE} as p2, {_WHOLE} as p3 from lineitem",
    "stored_slots": f"select l_orderkey, l_linenumber, {_NET} * (1 + l_tax) + {_NET} as before, l_extendedprice * l_discount as after from lineitem",
    "loss_many": """select p_partkey, (levenshtein(p_name, p_type) + levenshtein(p_type, p_brand))::double as texts, (levenshtein(p_name, p_type) + 1000)::double as short,
        round(1 + case when p_size % 3 = 0 then 0 else abs(p_retailprice - p_retailprice / 2) end, 6) as numbers,
        round(abs(p_size % 5 - p_size % 3) * 1000 + p_size * (least(p_size % 5, p_size % 3) + 1) + 2 * abs(p_retailprice - p_size), 6)::double as lists from part""",
    "fitted_line": "with p as (select (l_quantity - 25.5) / 15 as x, avg(l_extendedprice) / 10000 - 5 as y from lineitem group by l_quantity) select round(regr_slope(y, x), 3) as slope, round(regr_intercept(y, x), 3) as shift from p",
}
