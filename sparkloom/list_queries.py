"""Queries that run the scalar, string, list and pair operators over the driver's tables, with their SQL.

Lists are the quantities (v) and part keys by 7 (p) of an order's lines in the order of part, supplier and price, so
they aren't sorted. Lists are shown as text, value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions  # noqa: F401  registers the operators
from .registry import REGISTRY as op

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_LISTS = """with o as (select l_orderkey, list(l_quantity order by l_partkey, l_suppkey, l_extendedprice, l_quantity) as v, list((l_partkey % 7)::double order by l_partkey, l_suppkey, l_extendedprice, l_quantity) as p from lineitem group by l_orderkey)"""
#: Name of a result, its column, its SQL.
Shown = tuple[str, Callable[[], Column], str]


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("l"))
    return lines.select("l_orderkey", F.transform("l", lambda x: x["l_quantity"]).alias("v"), F.transform("l", lambda x: (x["l_partkey"] % 7).cast("double")).alias("p"))


def _text(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: x.cast("bigint").cast("string")), ",")


def _sql_text(v: str) -> str:
    return f"array_to_string(list_transform({v}, lambda x: x::bigint::varchar), ',')"


def _query(name: str, key: str, rows: Query, given: list[Shown], start: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir).select(key, *[column().alias(k) for k, column, _ in given])

    query.__name__ = name
    QUERIES[name] = query
    ORACLE_SQL[name] = start.replace("@", ", ".join(f'{sql} as "{k}"' for k, _, sql in given))


def _of_lists(name: str, given: list[Shown]) -> None:
    _query(name, "l_orderkey", lists, given, f"{_LISTS} select l_orderkey, @ from o")


def _of_parts(name: str, given: list[Shown]) -> None:
    _query(name, "p_partkey", lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/part.parquet"), given, "select p_partkey, @ from part")


def _list(name: str, sql: str, *args: Callable[[], Column] | str | float) -> Shown:
    """An operator whose list is shown as text."""
    return name, lambda: _text(op(name, *_columns(args))), _sql_text(sql)


def _columns(args: tuple) -> list[Column]:
    return [a() if callable(a) else F.col(a) if isinstance(a, str) else F.lit(a) for a in args]


def _value(name: str, sql: str, *args, types: list[str] | None = None) -> Shown:
    return name, lambda: op(name, *_columns(args), types=types), sql


def _typed(name: str, sql: str, types: list[str], *args) -> Shown:
    return name, lambda: _text(op(name, *_columns(args), types=types)), _sql_text(sql)


_N = lambda: F.size("v").cast("bigint")
_LOW = lambda: F.transform("v", lambda x: x - 25)
_PAIRS = lambda: op("mappings_a_to_b", F.col("v"), F.col("p"))
_LISTED = lambda name, sql, *args: (name, lambda: _text(F.transform(op(name, *_columns(args)), lambda x: x["_1"] * 100 + x["_2"])), _sql_text(sql))

_of_lists(
    "list_parts",
    [
        _value("pick_element_from_vector", "v[2]", "v", 2),
        _value("pick_last_element", "v[len(v)]", "v"),
        _value("index_of_first_true", "coalesce(list_position(list_transform(p, lambda x: x >= 1), true), -1)::bigint", "p"),
        _list("identity_list", "v", "v"),
        ("new_list", lambda: F.size(op("new_list")).cast("bigint"), "0::bigint"),
        _list("reverse_list", "list_reverse(v)", "v"),
        _list("make_list_from_one_element", "[v[1]]", lambda: F.col("v")[0]),
        _list("make_list_from_two_elements", "[v[1], p[1]]", lambda: F.col("v")[0], lambda: F.col("p")[0]),
        _list("make_list_from_three_elements", "[v[1], p[1], 7]", lambda: F.col("v")[0], lambda: F.col("p")[0], 7.0),
        _list("pick_from_inclusive_generic", "v[2:]", "v", 2),
        _list("pick_from_exclusive_generic", "v[3:]", "v", 2),
        _list("pick_until_inclusive_generic", "v[:2]", "v", 2),
        _list("pick_until_exclusive_generic", "v[:1]", "v", 2),
        _list("subset_list_of_tuples", "[v[1], p[1]]", _PAIRS, 1),
        _list("subset_by_mask", "list_transform(list_filter(list_zip(v, p), lambda z: z[2] > 3), lambda z: z[1])", "v", lambda: F.transform("p", lambda x: (x > 3).cast("bigint"))),
        _list("subset_by_indices", "[v[len(v)], v[1]]", "v", lambda: F.array(F.size("v").cast("bigint"), F.lit(1).cast("bigint"))),
        _list("sort_list", "list_sort(v)", "v"),
        _list("append_to_list", "list_append(v, 7)", "v", 7.0),
        _list("replace_by_mapping", "list_transform(p, lambda x: case when x = 1 then 10 when x = 2 then 20 else x end)", "p", lambda: F.array(F.struct(F.lit(1.0).alias("_1"), F.lit(10.0).alias("_2")), F.struct(F.lit(2.0).alias("_1"), F.lit(20.0).alias("_2")))),
        _list("replace_vec_at", "list_transform(v, lambda x, i: case when p[i] > 3 then i else x end)", "v", lambda: F.filter(F.transform("p", lambda x, i: F.when(x > 3, (i + 1).cast("double"))), lambda x: x.isNotNull()), lambda: F.transform("p", lambda x: (x > 3).cast("bigint"))),
        _list("unique_in_list", "list_filter(v, lambda x, i: list_position(v, x) = i)", "v"),
        _value("reduce_argmin", "list_position(v, list_min(v))::bigint", "v"),
        _value("find_first", "coalesce(list_position(p, 3), 0)::bigint", "p", 3.0),
        _LISTED("vector_of_products", "flatten(list_transform(p, lambda y: list_transform(v, lambda x: x * 100 + y)))", "v", "p"),
        _LISTED("vector_of_combinations", "flatten(list_transform(v, lambda x, i: list_transform(v[i + 1:], lambda y: x * 100 + y)))", "v"),
        _LISTED("mappings_a_to_b", "list_transform(v, lambda x, i: x * 100 + p[i])", "v", "p"),
    ],
)

_of_lists(
    "list_tests",
    [
        _list("is_sup_0", "list_transform(v, lambda x: (x > 25)::int)", _LOW),
        _list("is_eq_0", "list_transform(p, lambda x: (x = 0)::int)", "p"),
        _list("is_less_0", "list_transform(v, lambda x: (x < 25)::int)", _LOW),
        _list("mask", "list_transform(v, lambda x: (x > 25)::int)", _LOW),
        _list("inverse_mask", "list_transform(v, lambda x: (x <= 25)::int)", _LOW),
        _list("compare_tuple_a_gr_b", "list_transform(v, lambda x, i: (x > p[i])::int)", _PAIRS),
        _list("compare_tuple_a_eq_b", "list_transform(v, lambda x, i: (x = p[i])::int)", _PAIRS),
        _list("compare_tuple_a_less_b", "list_transform(v, lambda x, i: (x < p[i])::int)", _PAIRS),
        _list("is_more_than_right", "list_transform(v, lambda x, i: (x > coalesce(list_max(v[i + 1:]), -1))::int)", "v"),
        _list("is_more_eq_than_right", "list_transform(v, lambda x, i: (x >= coalesce(list_max(v[i + 1:]), -1))::int)", "v"),
        _list("is_eq_to_prev", "list_transform(p, lambda x, i: coalesce(i > 1 and x = p[i - 1], false)::int)", "p"),
        _list("even_indices_mask", "list_transform(v, lambda x, i: (i % 2 = 0)::int)", "v"),
        _list("odd_indices_mask", "list_transform(v, lambda x, i: (i % 2 = 1)::int)", "v"),
        _list("greater_than_broadcast", "list_transform(v, lambda x: (x > 20)::int)", "v", 20.0),
        _list("less_than_broadcast", "list_transform(v, lambda x: (x < 20)::int)", "v", 20.0),
        _list("eq_broadcast", "list_transform(p, lambda x: (x = 3)::int)", "p", 3.0),
        _typed("is_eq_to", "list_transform(p, lambda x: (x = 3)::int)", ["list<float>", "float"], "p", 3.0),
        _list("compare_two_vectors", "list_transform(v, lambda x, i: (x % 7 = p[i])::int)", lambda: F.transform("v", lambda x: x % 7), "p"),
    ],
)

_of_lists(
    "list_numbers",
    [
        _list("abs_vector", "list_transform(v, lambda x: abs(x - 25))", _LOW),
        _list("sum_broadcast", "list_transform(v, lambda x: x + 3)", "v", 3.0),
        _list("subtract_broadcast", "list_transform(v, lambda x: x - 3)", "v", 3.0),
        _list("mult_broadcast", "list_transform(v, lambda x: x * 3)", "v", 3.0),
        ("div_broadcast", lambda: F.round(F.aggregate(op("div_broadcast", F.col("v"), F.lit(3.0)), F.lit(0.0), lambda s, x: s + x), 6), "round(list_sum(list_transform(v, lambda x: x / 3)), 6)"),
        _list("sum_vector", "list_transform(v, lambda x, i: x + p[i])", "v", "p"),
        _list("subtract_vector", "list_transform(v, lambda x, i: x - p[i])", "v", "p"),
        _list("mult_vector", "list_transform(v, lambda x, i: x * p[i])", "v", "p"),
        ("div_vector", lambda: F.round(F.aggregate(op("div_vector", F.col("v"), F.transform("p", lambda x: x + 1)), F.lit(0.0), lambda s, x: s + x), 6), "round(list_sum(list_transform(v, lambda x, i: x / (p[i] + 1))), 6)"),
        _typed("ones_", "list_transform(v, lambda x: 1)", ["list<float>"], "v"),
        _typed("zeros_", "list_transform(v, lambda x: 0)", ["list<float>"], "v"),
        _list("recsum", "list_transform(v, lambda x, i: list_sum(v[:i]))", "v"),
        _list("recmult", "list_transform(range(4), lambda i: v[1] * pow(2, i))", lambda: F.col("v")[0], 2.0, 3),
        _list("range_", "range(1, v[1]::bigint + 1)", lambda: F.col("v")[0]),
        _list("int_divisors", "list_filter(range(1, v[1]::bigint + 1), lambda d: v[1]::bigint % d = 0)", lambda: F.col("v")[0].cast("bigint")),
        _list("sum_tuples_in_vector", "list_transform(v, lambda x, i: x + p[i])", _PAIRS),
        ("intersect_with_duplicates_factory", lambda: _text(F.array_sort(op("intersect_with_duplicates_factory", F.col("p"), F.transform("v", lambda x: x % 7)))), _sql_text("list_sort(flatten(list_transform(list_distinct(list_filter(p, lambda x: list_contains(list_transform(v, lambda y: y % 7), x))), lambda x: list_transform(range(least(len(list_filter(p, lambda y: y = x)), len(list_filter(v, lambda y: y % 7 = x)))), lambda i: x))))")),
        _value("reduce_sum", "list_sum(v)", "v"),
        _value("reduce_max", "list_max(v)", "v"),
        ("reduce_length", lambda: op("reduce_length", F.col("v"), types=["list<float>"]), "len(v)::bigint"),
        ("numbers_to_string", lambda: F.array_join(op("numbers_to_string", F.col("v")), ";"), "array_to_string(list_transform(v, lambda x: x::varchar), ';')"),
        _list("parse_from_list_string", "list_transform(v, lambda x: floor(x * 1.5))", lambda: op("numbers_to_string", F.transform("v", lambda x: x * 1.5))),
        _list("length_broadcast", "list_transform(v, lambda x: length(x::varchar))", lambda: op("numbers_to_string", F.col("v"))),
    ],
)


def _cased(case: str) -> list[Shown]:
    """The case family on p_name at "a", upper-cased first for the lower-case ones."""
    word = "uppercase" if case == "upper" else "lowercase"
    name, s, mark = ("p_name", "p_name", "a") if case == "upper" else (lambda: F.upper("p_name"), "upper(p_name)", "A")
    back = f"strpos(reverse({s}), '{mark}')"
    joined = lambda body: f"array_to_string(list_transform(string_split({s}, '{mark}'), lambda x, i: {body}), '{mark}')"
    return [
        _value(f"{word}_", f"{case}({s})", name),
        _value(f"{word}_at", f"{s}[1] || {case}({s}[2]) || {s}[3:]", name, 2),
        _value(f"{word}_after", f"case when strpos({s}, '{mark}') = 0 then {s} else left({s}, strpos({s}, '{mark}')) || {case}(substr({s}, strpos({s}, '{mark}') + 1)) end", name, lambda: F.lit(mark)),
        _value(f"{word}_before", f"case when {back} = 0 then {s} else {case}(left({s}, length({s}) - {back})) || right({s}, {back}) end", name, lambda: F.lit(mark)),
        _value(f"{word}_char_after", joined(f"case when i = 1 then x else {case}(x[1]) || x[2:] end"), name, lambda: F.lit(mark)),
        _value(f"{word}_char_before", joined(f"case when i = len(string_split({s}, '{mark}')) then x else x[:-2] || {case}(right(x, 1)) end"), name, lambda: F.lit(mark)),
    ]


_TITLE = "array_to_string(list_transform(regexp_extract_all({}, '[a-zA-Z]+|[^a-zA-Z]+'), lambda x: upper(x[1]) || lower(x[2:])), '')"
_WORDS = lambda: F.split("p_name", " ")
_of_parts("string_cases", [*_cased("upper"), *_cased("lower"), _value("capitalize_first", "upper(p_name[1]) || p_name[2:]", "p_name"), _value("capitalize_all", _TITLE.format("p_name"), "p_name"), ("capitalize_list_string", lambda: F.array_join(op("capitalize_list_string", _WORDS()), "|"), f"array_to_string(list_transform(string_split(p_name, ' '), lambda w: {_TITLE.format('w')}), '|')"), ("uppercasefirst_list_string", lambda: F.array_join(op("uppercasefirst_list_string", _WORDS()), "|"), "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '|')")])

_ODD = lambda: F.col("p_size") % 2
_of_parts(
    "string_choices",
    [
        _value("identity_str", "p_name", "p_name"),
        _value("empty_string", "''"),
        ("number_to_string", lambda: op("number_to_string", F.col("p_size")), "p_size::varchar"),
        ("parse_number", lambda: op("parse_number", F.col("p_size") / 2), "(p_size / 2)::double::varchar"),
        _value("if_string", "case when p_size % 2 <> 0 then p_name else '' end", "p_name", _ODD),
        _value("if_not_string", "case when p_size % 2 = 0 then p_name else '' end", "p_name", _ODD),
        _value("if_else_string", "case when p_size % 2 <> 0 then p_name else p_brand end", "p_name", "p_brand", _ODD),
        _value("longest_string", "case when length(p_name) >= length(p_type) then p_name else p_type end", "p_name", "p_type"),
        _value("shortest_string", "case when length(p_name) <= length(p_type) then p_name else p_type end", "p_name", "p_type"),
        _value("paste", "p_name || '-' || p_brand", "p_name", "p_brand", lambda: F.lit("-")),
        _value("paste0", "p_name || p_brand", "p_name", "p_brand"),
        _value("paste_with_space", "p_name || ' ' || p_brand", "p_name", "p_brand"),
        _value("paste_space_list_string", "replace(p_name, ' ', ' ')", _WORDS),
        _value("paste_list_string_sep", "replace(p_name, ' ', '+')", _WORDS, lambda: F.lit("+")),
        _value("paste_list_string", "replace(p_name, ' ', '')", _WORDS),
        ("match_with_overlap", lambda: _text(op("match_with_overlap", F.col("p_type"), F.lit("E"))), _sql_text("list_filter(range(1, length(p_type) + 1), lambda i: p_type[i] = 'E')")),
        ("split_string_to_vector", lambda: F.array_join(op("split_string_to_vector", F.col("p_type"), F.lit("E")), "|"), "array_to_string(string_split(p_type, 'E'), '|')"),
        _value("replace_pattern", "replace(p_type, 'E', '<>')", "p_type", lambda: F.lit("E"), lambda: F.lit("<>")),
        _value("remove_pattern", "replace(p_type, 'E', '')", "p_type", lambda: F.lit("E")),
        ("reduce_length", lambda: op("reduce_length", F.col("p_name"), types=["string"]), "length(p_name)::bigint"),
    ],
)

_of_parts(
    "scalar_values",
    [
        ("identity_bool", lambda: op("identity_bool", F.col("p_size") > 25), "p_size > 25"),
        _value("ret_true", "true"),
        _value("ret_false", "false"),
        ("parse_string", lambda: op("parse_string", F.when(F.col("p_size") % 3 == 0, "true").otherwise(F.col("p_brand"))), "p_size % 3 = 0"),
        _value("identity_int", "p_size", "p_size"),
        _value("identity_float", "p_retailprice", "p_retailprice"),
        ("ret_1", lambda: op("ret_1").cast("bigint"), "1::bigint"),
        _value("str_is_empty", "(p_size % 2 = 0)::bigint", lambda: F.when(_ODD() == 0, "").otherwise("x")),
        ("pi_", lambda: F.round(op("pi_"), 9), "round(pi(), 9)"),
        ("exp_", lambda: F.round(op("exp_", F.col("p_size") / 10.0), 6), "round(exp(p_size / 10.0::double), 6)"),
        ("log_", lambda: F.round(op("log_", F.col("p_retailprice")), 6), "round(ln(p_retailprice), 6)"),
        ("log10_", lambda: F.round(op("log10_", F.col("p_retailprice")), 6), "round(log10(p_retailprice), 6)"),
        ("number_div", lambda: F.round(op("number_div", F.col("p_retailprice"), F.col("p_size")), 6), "round(p_retailprice / p_size, 6)"),
        ("safe_div", lambda: F.round(op("safe_div", F.col("p_retailprice"), F.col("p_size") - 7), 6), "round(case when p_size = 7 then 0 else p_retailprice / (p_size - 7) end, 6)"),
    ],
)
