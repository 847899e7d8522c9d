"""Queries that run the catalogue, compiled programs, losses, selection and the search network over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    functions,  # noqa: F401  registers the operators
    image_queries,
    list_queries,
    program_queries,
)
from .functions.images import image
from .operators import losses, network, population
from .plans.program import Constant, Input, call, project
from .registry import REGISTRY as op


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(v: Column) -> Column:
    """A list of whole numbers as text."""
    return F.array_join(F.transform(v, lambda x: x.cast("bigint").cast("string")), ",")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted quantities and part keys of each order."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
    return lines.agg(F.array_sort(F.collect_list("l_quantity")).alias("v"), F.array_sort(F.collect_list((F.col("l_partkey") % 7).cast("double"))).alias("p"))


_LISTS = "with o as (select l_orderkey, list(l_quantity order by l_quantity) as v, list((l_partkey % 7)::double order by l_partkey % 7) as p from lineitem group by l_orderkey)"
_SHOW = "array_to_string(list_transform({}, lambda x: x::bigint::varchar), ',')"


def fuel_cost(spark, sf_dir):
    """sum(floor(v / 3) - 2) as a compiled program."""
    third = call("div_broadcast", Input("v", "list<float>"), Constant(3.0, "float"))
    less = call("reduce_sum", call("subtract_broadcast", third, Constant(2.0, "float")))
    floors = _orders(spark, sf_dir).withColumn("v", F.transform("v", lambda x: F.floor(x / 3).cast("double") * 3))
    return project(floors, {"fuel": less}).select("l_orderkey", "fuel")


def program_outputs(spark, sf_dir):
    """Two outputs that share a sub-program."""
    v = Input("v", "list<float>")
    total = call("reduce_sum", v)
    outputs = {"mean": call("number_div", total, call("reduce_length", v)), "excess": call("number_minus", total, call("reduce_max", v))}
    return project(_orders(spark, sf_dir), outputs).select("l_orderkey", F.round("mean", 6).alias("mean"), "excess")


def scalar_numbers(spark, sf_dir):
    a, b = F.col("l_quantity"), F.col("l_discount")
    out = {"total": op("number_sum", a, b), "minus": op("number_minus", a, b), "product": op("number_mult", a, b), "safe": op("safe_div", a, b), "rest": op("modulo", a, F.lit(7.0)), "logged": op("log_", b), "relu": op("relu", a - 25), "power": op("power_of", a, F.lit(2.0)), "tanh": op("tanh", b)}
    grouped = _table(spark, sf_dir, "lineitem").select("l_returnflag", *[c.alias(k) for k, c in out.items()])
    return grouped.groupBy("l_returnflag").agg(*[F.round(F.sum(k), 2).alias(k) for k in out])


def scalar_conditions(spark, sf_dir):
    n = F.col("p_size")
    flags = {"eq": op("is_eq_to", n, F.lit(7), types=["int", "int"]), "gt": op("experimental_is_gt", n, F.lit(25)), "lt": op("experimental_is_lt", n, F.lit(25)), "neither": op("experimental_not", n - 1), "picked": op("if_else_multiplexer", n - 25, n, F.lit(0))}
    return _table(spark, sf_dir, "part").select("p_partkey", *[c.cast("bigint").alias(k) for k, c in flags.items()])


def strings(spark, sf_dir):
    s = F.col("p_name")
    out = {"upper": op("uppercase_", s), "upper_at": op("uppercase_at", s, F.lit(2)), "after": op("uppercase_after", s, F.lit("a")), "before": op("uppercase_before", s, F.lit("a")), "first": op("capitalize_first", s), "replaced": op("replace_pattern", s, F.lit("a"), F.lit("<>")), "once": op("replace_first_pattern", s, F.lit("a"), F.lit("<>")), "removed": op("remove_pattern", s, F.lit("e")), "pasted": op("paste", s, F.col("p_brand"), F.lit("-")), "longest": op("longest_string", s, F.col("p_brand")), "backwards": F.array_join(op("reverse_broadcast", op("split_string_to_vector", s, F.lit(" "))), " ")}
    return _table(spark, sf_dir, "part").select("p_partkey", *[c.alias(k) for k, c in out.items()])


def list_masks(spark, sf_dir):
    v = F.col("v")
    out = {"above": op("greater_than_broadcast", v, F.lit(20.0)), "even": op("even_indices_mask", v), "leaders": op("is_more_eq_than_right", v), "same": op("is_eq_to_prev", v), "equal": op("eq_broadcast", v, F.lit(10.0))}
    return _orders(spark, sf_dir).select("l_orderkey", *[_text(c).alias(k) for k, c in out.items()])


def list_arithmetic(spark, sf_dir):
    v, p = F.col("v"), F.col("p")
    out = {"summed": op("sum_vector", v, p), "product": op("mult_vector", v, p), "running": op("recsum", v), "shifted": op("subtract_broadcast", v, F.lit(3.0)), "tail": op("pick_from_exclusive_generic", v, F.lit(1)), "head": op("pick_until_inclusive_generic", v, F.lit(2))}
    return _orders(spark, sf_dir).select("l_orderkey", *[_text(c).alias(k) for k, c in out.items()], op("reduce_argmax", v).alias("argmax"), op("reduce_min", v).alias("least"), op("find_first", v, F.lit(10.0)).alias("found"))


def list_sets(spark, sf_dir):
    v, p = F.transform("v", lambda x: x % 7), F.col("p")
    out = {"common": F.array_sort(op("intersect", v, p)), "kept": F.array_sort(op("left_join", v, p)), "bag": F.array_sort(op("intersect_with_duplicates", v, p)), "distinct": F.array_sort(op("unique_in_list", v)), "joined": F.array_sort(op("concat_two_lists", v, p))}
    return _orders(spark, sf_dir).select("l_orderkey", *[_text(c).alias(k) for k, c in out.items()])


def list_pairs(spark, sf_dir):
    v, p = F.col("v"), F.col("p")
    return _orders(spark, sf_dir).select("l_orderkey", F.size(op("vector_of_products", v, p)).cast("bigint").alias("products"), F.size(op("vector_of_combinations", v)).cast("bigint").alias("combinations"), _text(op("sum_tuples_in_vector", op("mappings_a_to_b", v, p))).alias("zipped"), _text(op("compare_tuple_a_gr_b", op("mappings_a_to_b", v, p))).alias("greater"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 images, scaled to 0..1."""
    e = _table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    lo, hi = F.array_min("e"), F.array_max("e")
    return e.select("vec_id", image(F.lit(8), F.lit(8), "intensity", F.transform("e", lambda x: (x - lo) / (hi - lo))).alias("img"))


def image_pixels(spark, sf_dir):
    a = F.col("img")
    sums = {"inverted": op("experimental_invert_2D", a), "half": op("bmult_image2D", a, F.lit(0.5)), "squared": op("mult_img2D", a, a), "white": op("experimental_tobinary_th_image2D_factory", a, F.lit(0.5))}
    out = [F.round(F.aggregate(c["pixels"], F.lit(0.0), lambda s, x: s + x), 5).alias(k) for k, c in sums.items()]
    return _images(spark, sf_dir).select("vec_id", *out, F.round(op("reduce_mean", a, types=["image"]), 6).alias("mean"), F.round(op("reduce_std", a, types=["image"]), 6).alias("std"), op("experimental_vertical_argmax", a).cast("bigint").alias("row"))


def image_windows(spark, sf_dir):
    a = F.col("img")
    total = lambda c: F.round(F.aggregate(c["pixels"], F.lit(0.0), lambda s, x: s + x), 5)
    return _images(spark, sf_dir).select("vec_id", total(op("avgpool_blocks", a, F.lit(2.0))).alias("avg_blocks"), total(op("maxpool_blocks", a, F.lit(4.0))).alias("max_blocks"))


def image_binary(spark, sf_dir):
    """How many pixels each way of binarisation sets."""
    a = F.col("img")
    made = {"manual": op("binarize_manual2D", a, F.lit(102), types=["image", "int"]), "adaptive": op("binarize_adaptive2D", a, F.lit(5)), "niblack": op("binarize_niblack2D", a, F.lit(5)), "sauvola": op("binarize_sauvola2D", a, F.lit(5))}
    return _images(spark, sf_dir).select("vec_id", *[F.aggregate(c["pixels"], F.lit(0.0), lambda s, x: s + x).alias(k) for k, c in made.items()])


def _network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from the events: each event leads to its user's next one."""
    from pyspark.sql import Window

    e = _table(spark, sf_dir, "events")
    nodes = e.select(F.col("event_id").cast("string").alias("id_hash"), F.col("event_type").alias("behavior"))
    follows = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    edges = e.select(F.col("event_id").cast("string").alias("_from"), follows.cast("string").alias("_to"), (F.col("event_id") % 100).alias("iteration"), F.round("value", 2).alias("fitness")).where("_to is not null")
    return nodes, edges


_NETWORK = """with nodes as (select event_id::varchar as id_hash, event_type as behavior from events),
    edges as (select * from (select event_id::varchar as _from, (lead(event_id) over (partition by user_id order by ts, event_id))::varchar as _to, event_id % 100 as iteration, round(value, 2) as fitness from events) where _to is not null)"""


def network_top(spark, sf_dir):
    return network.top_elites(*_network(spark, sf_dir), 3)


def network_fittest(spark, sf_dir):
    nodes, edges = _network(spark, sf_dir)
    return network.fittest_of(nodes, edges, nodes.select("behavior").distinct())


def network_behaviours(spark, sf_dir):
    return network.behaviours(*_network(spark, sf_dir))


def loss_levenshtein(spark, sf_dir):
    pairs = _table(spark, sf_dir, "part").select("p_partkey", losses.levenshtein(F.col("p_name"), F.col("p_type")).alias("loss"))
    return pairs.groupBy((F.col("p_partkey") % 10).alias("bucket")).agg(F.round(F.avg("loss"), 6).alias("loss"))


def elite_orders(spark, sf_dir):
    pop = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ind_id"), F.col("o_totalprice").alias("fitness"))
    return population.elites(pop, 25)


def pareto_parts(spark, sf_dir):
    """The first three fronts of size and price."""
    pop = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ind_id"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return population.pareto_ranks(pop, ["a", "b"], fronts=3).select("ind_id", "a", "b", F.col("rank").cast("bigint").alias("rank"))


def pareto_orders(spark, sf_dir):
    """The first front of three objectives of the orders."""
    o = _table(spark, sf_dir, "orders")
    pop = o.select(F.col("o_orderkey").alias("ind_id"), F.col("o_totalprice").alias("a"), (F.col("o_custkey") % 1000).cast("double").alias("b"), F.datediff(F.lit("1999-01-01"), "o_orderdate").cast("double").alias("c"))
    return population.pareto_ranks(pop, ["a", "b", "c"], fronts=1).select("ind_id", "a", "b", "c")


def crowded_parts(spark, sf_dir):
    """The room around each part among those of its size, by price and name length."""
    ranked = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ind_id"), F.col("p_size").alias("rank"), F.col("p_retailprice").alias("a"), F.length("p_name").cast("double").alias("b"))
    room = F.col("crowding")
    return population.crowding(ranked, ["a", "b"]).select("ind_id", F.when(room == float("inf"), -1.0).otherwise(F.round(room, 6)).alias("room"))


def archive_state(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ind_id"), (F.col("o_custkey") % 100).alias("cell"), F.col("o_totalprice").alias("fitness"))
    return population.coverage(o, 128).select(F.round("coverage", 6).alias("coverage"), "best", "best_id")


def fitness_spread(spark, sf_dir):
    found = population.fitness_statistics(_table(spark, sf_dir, "orders"), "o_totalprice", 8)
    shown = F.array_join(F.transform("histogram", lambda x: x.cast("string")), ",").alias("histogram")
    return found.select("n", "least", F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"), "largest", shown)


def nearest_cells(spark, sf_dir):
    """The nearest of twenty embeddings to each embedding."""
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ind_id"), F.transform("embedding", lambda x: x.cast("double")).alias("descriptor"))
    centres = e.where("ind_id < 20").select(F.col("ind_id").alias("cell"), F.col("descriptor").alias("centre"))
    return population.nearest_cell(e, centres)


def archive_best(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ind_id"), F.col("o_orderpriority").alias("cell"), F.col("o_totalprice").alias("fitness"))
    return population.archive_insert(o.where("ind_id % 2 = 0"), o.where("ind_id % 2 = 1"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (fuel_cost, program_outputs, scalar_numbers, scalar_conditions, strings, list_masks, list_arithmetic, list_sets, list_pairs, image_pixels, image_windows, image_binary, network_top, network_fittest, network_behaviours, loss_levenshtein, elite_orders, pareto_parts, pareto_orders, crowded_parts, archive_state, fitness_spread, nearest_cells, archive_best)} | image_queries.QUERIES | list_queries.QUERIES | program_queries.QUERIES


def _shown(**lists: str) -> str:
    return ", ".join(f"{_SHOW.format(v)} as {k}" for k, v in lists.items())


_IMAGES = "with e as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings where len(embedding) = 64), i as (select vec_id, list_transform(e, lambda x: (x - list_min(e)) / (list_max(e) - list_min(e))) as p from e)"

ORACLE_SQL: dict[str, str] = {
    "fuel_cost": "select l_orderkey, sum(floor(l_quantity / 3) - 2) as fuel from lineitem group by l_orderkey",
    "program_outputs": "select l_orderkey, round(sum(l_quantity) / count(*), 6) as mean, sum(l_quantity) - max(l_quantity) as excess from lineitem group by l_orderkey",
    "scalar_numbers": "select l_returnflag, round(sum(l_quantity + l_discount), 2) as total, round(sum(l_quantity - l_discount), 2) as minus, round(sum(l_quantity * l_discount), 2) as product, round(sum(case when l_discount = 0 then 0 else l_quantity / l_discount end), 2) as safe, round(sum(l_quantity % 7), 2) as rest, round(sum(ln(greatest(l_discount, 1e-10))), 2) as logged, round(sum(greatest(l_quantity - 25, 0)), 2) as relu, round(sum(pow(l_quantity, 2)), 2) as power, round(sum(tanh(l_discount)), 2) as tanh from lineitem group by l_returnflag",
    "scalar_conditions": "select p_partkey, (p_size = 7)::bigint as eq, (p_size > 25)::bigint as gt, (p_size < 25)::bigint as lt, (p_size - 1 <= 0.5)::bigint as neither, (case when p_size > 25 then p_size else 0 end)::bigint as picked from part",
    "strings": """select p_partkey, upper(p_name) as upper, p_name[1] || upper(p_name[2]) || p_name[3:] as upper_at,
        case when strpos(p_name, 'a') = 0 then p_name else left(p_name, strpos(p_name, 'a')) || upper(substr(p_name, strpos(p_name, 'a') + 1)) end as after,
        case when strpos(p_name, 'a') = 0 then p_name else upper(left(p_name, length(p_name) - strpos(reverse(p_name), 'a'))) || substr(p_name, length(p_name) - strpos(reverse(p_name), 'a') + 1) end as before,
        upper(p_name[1]) || p_name[2:] as first, replace(p_name, 'a', '<>') as replaced,
        case when strpos(p_name, 'a') = 0 then p_name else left(p_name, strpos(p_name, 'a') - 1) || '<>' || substr(p_name, strpos(p_name, 'a') + 1) end as once,
        replace(p_name, 'e', '') as removed, p_name || '-' || p_brand as pasted, case when length(p_name) >= length(p_brand) then p_name else p_brand end as longest,
        array_to_string(list_transform(string_split(p_name, ' '), lambda x: reverse(x)), ' ') as backwards from part""",
    "list_masks": f"{_LISTS} select l_orderkey, " + _shown(above="list_transform(v, lambda x: (x > 20)::int)", even="list_transform(v, lambda x, i: (i % 2 = 0)::int)", leaders="list_transform(v, lambda x, i: coalesce(x >= list_max(v[i + 1:]), true)::int)", same="list_transform(v, lambda x, i: coalesce(i > 1 and x = v[i - 1], false)::int)", equal="list_transform(v, lambda x: (x = 10)::int)") + " from o",
    "list_arithmetic": f"{_LISTS} select l_orderkey, " + _shown(summed="list_transform(v, lambda x, i: x + p[i])", product="list_transform(v, lambda x, i: x * p[i])", running="list_transform(v, lambda x, i: list_sum(v[:i]))", shifted="list_transform(v, lambda x: x - 3)", tail="v[2:]", head="v[:2]") + ", list_position(v, list_max(v))::bigint as argmax, list_min(v) as least, coalesce(list_position(v, 10), 0)::bigint as found from o",
    "list_sets": """with l as (select l_orderkey, l_quantity % 7 as a, (l_partkey % 7)::double as b from lineitem),
        a as (select l_orderkey, a as x, count(*) as n from l group by all), b as (select l_orderkey, b as x, count(*) as n from l group by all),
        j as (select a.l_orderkey, a.x, a.n as n, least(a.n, b.n) as m from a join b on a.l_orderkey = b.l_orderkey and a.x = b.x),
        k as (select l_orderkey, string_agg(x::bigint::varchar, ',' order by x) as common, string_agg(rtrim(repeat(x::bigint::varchar || ',', n), ','), ',' order by x) as kept, string_agg(rtrim(repeat(x::bigint::varchar || ',', m), ','), ',' order by x) as bag from j group by l_orderkey),
        d as (select l_orderkey, string_agg(x::bigint::varchar, ',' order by x) as distinct_ from a group by l_orderkey),
        u as (select l_orderkey, string_agg(x::bigint::varchar, ',' order by x) as joined from (select l_orderkey, a as x from l union all select l_orderkey, b from l) group by l_orderkey)
        select d.l_orderkey, coalesce(common, '') as common, coalesce(kept, '') as kept, coalesce(bag, '') as bag, distinct_ as "distinct", joined from d join u using (l_orderkey) left join k using (l_orderkey)""",
    "list_pairs": f"{_LISTS} select l_orderkey, (len(v) * len(p))::bigint as products, (len(v) * (len(v) - 1) // 2)::bigint as combinations, " + _shown(zipped="list_transform(v, lambda x, i: x + p[i])", greater="list_transform(v, lambda x, i: (x > p[i])::int)") + " from o",
    "image_pixels": f"{_IMAGES} select vec_id, round(list_sum(list_transform(p, lambda x: abs(1 - x))), 5) as inverted, round(list_sum(list_transform(p, lambda x: x * 0.5)), 5) as half, round(list_sum(list_transform(p, lambda x: x * x)), 5) as squared, list_sum(list_transform(p, lambda x: (x > 0.5)::int::double)) as white, round(list_avg(p), 6) as mean, round(list_stddev_samp(p), 6) as std, ((list_position(p, list_max(p)) - 1) % 8 + 1)::bigint as row from i",
    "image_windows": f"{_IMAGES}, x as (select vec_id, unnest(p) as v, generate_subscripts(p, 1) - 1 as k from i), g as (select vec_id, avg(v) over (partition by vec_id, (k % 8) // 2, (k // 8) // 2) as a, max(v) over (partition by vec_id, (k % 8) // 4, (k // 8) // 4) as m from x) select vec_id, round(sum(a), 5) as avg_blocks, round(sum(m), 5) as max_blocks from g group by vec_id",
    "image_binary": f"""{_IMAGES}, x as (select vec_id, unnest(p) as v, generate_subscripts(p, 1) - 1 as k from i),
        n as (select a.vec_id, a.k, any_value(a.v) as v, avg(b.v) as m, stddev_pop(b.v) as s, avg(b.v) filter (where abs(a.k % 8 - b.k % 8) <= 2 and abs(a.k // 8 - b.k // 8) <= 2) as near
            from x a join x b on a.vec_id = b.vec_id and abs(a.k % 8 - b.k % 8) <= 5 and abs(a.k // 8 - b.k // 8) <= 5 group by 1, 2)
        select vec_id, count_if(v >= 0.4)::double as manual, count_if(v > near * 0.85)::double as adaptive, count_if(v > m + 0.2 * s)::double as niblack, count_if(v > m * (1 + 0.2 * (s / 0.5 - 1)))::double as sauvola from n group by vec_id""",
    "network_top": f"{_NETWORK}, t as (select _to, fitness, max(iteration) as iteration from edges group by _to, fitness order by fitness, iteration desc, _to limit 3) select id_hash, behavior, fitness, iteration from nodes join t on id_hash = _to",
    "network_fittest": f"{_NETWORK}, r as (select id_hash, behavior, fitness, row_number() over (partition by behavior order by fitness, id_hash) as rn from edges join nodes on id_hash = _to) select id_hash, behavior, fitness from r where rn = 1",
    "network_behaviours": f"{_NETWORK} select behavior, max(iteration) as newness from edges join nodes on id_hash = _to group by behavior",
    "loss_levenshtein": "select p_partkey % 10 as bucket, round(avg(levenshtein(p_name, p_type)), 6) as loss from part group by 1",
    "elite_orders": "select o_orderkey as ind_id, o_totalprice as fitness from orders order by o_totalprice, o_orderkey desc limit 25",
    "pareto_parts": """with p as (select p_partkey as ind_id, p_size::double as a, p_retailprice as b from part),
        f1 as (select * from p where not exists (select 1 from p q where q.a <= p.a and q.b <= p.b and (q.a < p.a or q.b < p.b))), r1 as (select * from p where ind_id not in (select ind_id from f1)),
        f2 as (select * from r1 p where not exists (select 1 from r1 q where q.a <= p.a and q.b <= p.b and (q.a < p.a or q.b < p.b))), r2 as (select * from r1 where ind_id not in (select ind_id from f2)),
        f3 as (select * from r2 p where not exists (select 1 from r2 q where q.a <= p.a and q.b <= p.b and (q.a < p.a or q.b < p.b)))
        select *, 1::bigint as rank from f1 union all select *, 2 from f2 union all select *, 3 from f3""",
    "pareto_orders": """with p as (select o_orderkey as ind_id, o_totalprice as a, (o_custkey % 1000)::double as b, date_diff('day', o_orderdate::date, date '1999-01-01')::double as c from orders)
        select * from p where not exists (select 1 from p q where q.a <= p.a and q.b <= p.b and q.c <= p.c and (q.a < p.a or q.b < p.b or q.c < p.c))""",
    "crowded_parts": """with p as (select p_partkey as ind_id, p_size as f, p_retailprice as a, length(p_name)::double as b from part),
        g as (select *, lead(a) over (partition by f order by a, ind_id) - lag(a) over (partition by f order by a, ind_id) as ga, lead(b) over (partition by f order by b, ind_id) - lag(b) over (partition by f order by b, ind_id) as gb,
            max(a) over (partition by f) - min(a) over (partition by f) as wa, max(b) over (partition by f) - min(b) over (partition by f) as wb from p)
        select ind_id, coalesce(round(case when wa = 0 then ga * 0 else ga / wa end + case when wb = 0 then gb * 0 else gb / wb end, 6), -1.0)::double as room from g""",
    "archive_state": "select round(count(distinct o_custkey % 100) / 128, 6) as coverage, min(o_totalprice) as best, arg_min(o_orderkey, (o_totalprice, o_orderkey)) as best_id from orders",
    "fitness_spread": """with e as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders), b as (select o_totalprice as f, least(7, floor((o_totalprice - lo) / (hi - lo) * 8)) as b from orders, e)
        select count(*) as n, min(f) as least, round(avg(f), 4) as mean, round(stddev_samp(f), 4) as deviation, max(f) as largest, concat_ws(',', """ + ", ".join(f"count_if(b = {i})::bigint::varchar" for i in range(8)) + """) as histogram from b""",
    "nearest_cells": """with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), d as (select p.vec_id, c.vec_id as cell, list_sum(list_transform(p.v, lambda x, i: (x - c.v[i]) * (x - c.v[i]))) as d from e p, e c where c.vec_id < 20)
        select vec_id as ind_id, arg_min(cell, (d, cell)) as cell from d group by vec_id""",
    "archive_best": "select ind_id, cell, fitness from (select o_orderkey as ind_id, o_orderpriority as cell, o_totalprice as fitness, row_number() over (partition by o_orderpriority order by o_totalprice, o_orderkey % 2 desc, o_orderkey desc) as k from orders) where k = 1",
} | image_queries.ORACLE_SQL | list_queries.ORACLE_SQL | program_queries.ORACLE_SQL
