"""Operators on lists and lists of pairs, as higher-order functions. Positions count from 1."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import op
from .scalar import mask


def _same_size(a: Column, b: Column, then: Column) -> Column:
    return F.when(F.size(a) == F.size(b), then)


def _cut(v: Column, start: Column, n: Column) -> Column:
    return F.slice(v, start.cast("int"), n.cast("int"))


# ---- elements


@op("list int", "any")
def pick_element_from_vector(v, at):
    """Fails outside the list."""
    return F.get(v, (at - 1).cast("int"))


@op("list", "any")
def pick_last_element(v):
    return F.get(v, F.size(v) - 1)


@op("list<number> number", "int")
def find_first(v, what):
    """Position of the first equal value; 0 without one."""
    return F.array_position(v, what)


@op("list<number>", "int")
def index_of_first_true(v):
    """Position of the first value from 1 on; -1 without one."""
    at = F.filter(F.transform(v, lambda x, i: F.when(x >= 1, i + 1)), lambda x: x.isNotNull())
    return F.coalesce(F.get(at, F.lit(0)), F.lit(-1)).cast("bigint")


# ---- lists


@op("list", "list")
def identity_list(v):
    return v


@op("", "list")
def new_list():
    return F.array()


@op("list", "list")
def reverse_list(v):
    return F.reverse(v)


@op("list list", "list")
def concat_two_lists(a, b):
    return F.concat(a, b)


@op("any", "list")
def make_list_from_one_element(a):
    return F.array(a)


@op("any any", "list")
def make_list_from_two_elements(a, b):
    return F.array(a, b)


@op("any any any", "list")
def make_list_from_three_elements(a, b, c):
    return F.array(a, b, c)


@op("list list", "list")
def intersect(a, b):
    """Distinct values of both lists, in the order of the first."""
    return F.array_intersect(a, b)


@op("list list", "list")
def left_join(a, b):
    """Values of a that occur in b, with repeats."""
    return F.filter(a, lambda x: F.array_contains(b, x))


@op("list list", "list", also=["intersect_with_duplicates_factory"])
def intersect_with_duplicates(a, b):
    """Each common value as often as in the list that has fewer of it."""
    times = lambda v, x: F.size(F.filter(v, lambda y: y == x))
    return F.flatten(F.transform(F.array_intersect(a, b), lambda x: F.array_repeat(x, F.least(times(a, x), times(b, x)))))


@op("list int", "list")
def pick_from_inclusive_generic(v, at):
    return _cut(v, F.greatest(at, F.lit(1)), F.size(v))


@op("list int", "list")
def pick_from_exclusive_generic(v, at):
    return _cut(v, F.greatest(at, F.lit(1)) + 1, F.size(v))


@op("list int", "list")
def pick_until_inclusive_generic(v, at):
    return _cut(v, F.lit(1), F.greatest(at, F.lit(0)))


@op("list int", "list")
def pick_until_exclusive_generic(v, at):
    return _cut(v, F.lit(1), F.greatest(at - 1, F.lit(0)))


@op("pairs int", "list")
def subset_list_of_tuples(v, at):
    pair = F.get(v, (at - 1).cast("int"))
    return F.when(pair.isNotNull(), F.array(pair["_1"], pair["_2"]))


@op("list list<number>", "list")
def subset_by_mask(v, m):
    return _same_size(v, m, F.filter(v, lambda x, i: F.get(m, i) > 0))


@op("list list<int>", "list")
def subset_by_indices(v, m):
    """Fails if an index is outside the list."""
    return F.when(F.forall(m, lambda i: i.between(1, F.size(v))), F.transform(m, lambda i: F.get(v, (i - 1).cast("int"))))


@op("list", "list")
def sort_list(v):
    return F.array_sort(v)


@op("list any", "list")
def append_to_list(v, x):
    return F.array_append(v, x)


@op("list", "list")
def unique_in_list(v):
    return F.array_distinct(v)


@op("list pairs", "list")
def replace_by_mapping(v, pairs):
    """The second value of the first pair that starts with the element."""
    return F.transform(v, lambda x: F.coalesce(F.get(F.filter(pairs, lambda p: p["_1"] == x), F.lit(0))["_2"], x))


@op("list list list<int>", "list")
def replace_vec_at(v1, v2, at):
    """Values of v2, in turn, where at > 0; fails if their numbers differ."""
    ok = (F.size(at) == F.size(v1)) & (F.size(v2) == F.size(F.filter(at, lambda a: a > 0)))
    return F.when(ok, F.transform(v1, lambda x, i: F.when(F.get(at, i) > 0, F.get(v2, F.size(F.filter(F.slice(at, F.lit(1), i + 1), lambda a: a > 0)) - 1)).otherwise(x)))


# ---- masks


def _mask_op(name: str, test: Callable[[Column], Column], doc: str) -> None:
    @op("list<number>", "list<int>", name=name)
    def build(v):
        return F.transform(v, lambda x: mask(test(x)))

    build.__doc__ = doc


for _name, _test in {"is_sup_0": lambda x: x > 0, "is_eq_0": lambda x: x == 0, "is_less_0": lambda x: x < 0, "mask": lambda x: x > 0, "inverse_mask": lambda x: x <= 0}.items():
    _mask_op(_name, _test, "1 where the test holds")


@op("list<number> number", "list<int>", also=["eq_broadcast"])
def is_eq_to(v, n):
    return F.transform(v, lambda x: mask(x == n))


@op("list<number> number", "list<int>")
def greater_than_broadcast(v, n):
    return F.transform(v, lambda x: mask(x > n))


@op("list<number> number", "list<int>")
def less_than_broadcast(v, n):
    return F.transform(v, lambda x: mask(x < n))


@op("pairs", "list<int>")
def compare_tuple_a_gr_b(t):
    return F.transform(t, lambda p: mask(p["_1"] > p["_2"]))


@op("pairs", "list<int>")
def compare_tuple_a_eq_b(t):
    return F.transform(t, lambda p: mask(p["_1"] == p["_2"]))


@op("pairs", "list<int>")
def compare_tuple_a_less_b(t):
    return F.transform(t, lambda p: mask(p["_1"] < p["_2"]))


def _from_right(v: Column, test: Callable[[Column, Column], Column]) -> Column:
    """The test of each value and the largest one after it, in one fold from the right; the last value passes."""
    start = F.struct(F.lit(None).cast("double").alias("top"), F.array().cast("array<bigint>").alias("out"))
    step = lambda acc, x: F.struct(F.greatest(acc["top"], x.cast("double")).alias("top"), F.array_append(acc["out"], mask(acc["top"].isNull() | test(x, acc["top"]))).alias("out"))
    return F.reverse(F.aggregate(F.reverse(v), start, step, lambda acc: acc["out"]))


@op("list<number>", "list<int>")
def is_more_than_right(v):
    """1 where a value is above all that follow."""
    return _from_right(v, lambda x, top: x > top)


@op("list<number>", "list<int>")
def is_more_eq_than_right(v):
    return _from_right(v, lambda x, top: x >= top)


@op("list<number>", "list<int>")
def is_eq_to_prev(v):
    """1 where a value equals the one before; the first gets 0."""
    return F.transform(v, lambda x, i: mask((i > 0) & F.coalesce(x == F.get(v, i - 1), F.lit(False))))


@op("list", "list<int>")
def even_indices_mask(v):
    return F.transform(v, lambda x, i: mask((i + 1) % 2 == 0))


@op("list", "list<int>")
def odd_indices_mask(v):
    return F.transform(v, lambda x, i: mask((i + 1) % 2 == 1))


@op("list<number> list<number>", "list<int>")
def compare_two_vectors(a, b):
    return _same_size(a, b, F.zip_with(a, b, lambda x, y: mask(x == y)))


# ---- arithmetic


@op("int", "list<int>")
def int_divisors(n):
    """Ascending divisors, from pairs up to the square root; fails below 1."""
    root = F.floor(F.sqrt(F.greatest(n, F.lit(1)).cast("double"))).cast("bigint")
    small = F.filter(F.sequence(F.lit(1).cast("bigint"), root), lambda d: n % d == 0)
    large = F.filter(F.transform(F.reverse(small), lambda d: F.try_divide(n, d).cast("bigint")), lambda d: d > root)
    return F.when(n >= 1, F.concat(small, large))


@op("list<number>", "list<number>")
def abs_vector(v):
    return F.transform(v, lambda x: F.abs(x))


@op("list<number> number", "list<number>")
def sum_broadcast(v, n):
    return F.transform(v, lambda x: x + n)


@op("list<number> number", "list<number>")
def subtract_broadcast(v, n):
    return F.transform(v, lambda x: x - n)


@op("list<number> number", "list<number>")
def mult_broadcast(v, n):
    return F.transform(v, lambda x: x * n)


@op("list<number> number", "list<float>")
def div_broadcast(v, n):
    """Fails for n = 0."""
    return F.when(n != 0, F.transform(v, lambda x: F.try_divide(x, n)))


def _stretched(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """A list of one value is repeated to the other's length."""
    one = lambda v, w: F.when((F.size(v) == 1) & (F.size(w) > 1), F.array_repeat(F.get(v, F.lit(0)), F.size(w))).otherwise(v)
    return one(a, b), one(b, a), (F.size(a) == F.size(b)) | (F.size(a) == 1) & (F.size(b) > 1) | (F.size(b) == 1) & (F.size(a) > 1)


@op("list<number> list<number>", "list<number>")
def sum_vector(a, b):
    """Fails if the lengths differ."""
    return _same_size(a, b, F.zip_with(a, b, lambda x, y: x + y))


@op("list<number> list<number>", "list<number>")
def subtract_vector(a, b):
    x, y, ok = _stretched(a, b)
    return F.when(ok, F.zip_with(x, y, lambda p, q: p - q))


@op("list<number> list<number>", "list<number>")
def mult_vector(a, b):
    x, y, ok = _stretched(a, b)
    return F.when(ok, F.zip_with(x, y, lambda p, q: p * q))


@op("list<number> list<number>", "list<float>")
def div_vector(a, b):
    """Fails if a divisor is 0."""
    x, y, ok = _stretched(a, b)
    return F.when(ok & ~F.exists(b, lambda q: q == 0), F.zip_with(x, y, lambda p, q: F.try_divide(p, q)))


@op("list<number>", "list<float>", name="ones_")
def ones_like(v):
    return F.transform(v, lambda x: F.lit(1.0))


@op("int", "list<float>", name="ones_")
def ones(n):
    return F.when(n >= 0, F.array_repeat(F.lit(1.0), n.cast("int")))


@op("list<number>", "list<float>", name="zeros_")
def zeros_like(v):
    return F.transform(v, lambda x: F.lit(0.0))


@op("int", "list<float>", name="zeros_")
def zeros(n):
    return F.when(n >= 0, F.array_repeat(F.lit(0.0), n.cast("int")))


@op("pairs<number>", "list<number>")
def sum_tuples_in_vector(t):
    return F.transform(t, lambda p: p["_1"] + p["_2"])


@op("list<number>", "list<number>")
def recsum(v):
    """Running sums."""
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(v, start, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["out"], acc["sum"] + x).alias("out")), lambda acc: acc["out"])


@op("number number int", "list<number>")
def recmult(start, by, times):
    """A geometric series of times + 1 terms; fails from 10,000 on or below 0."""
    steps = F.when(times > 0, F.sequence(F.lit(1), F.least(times, F.lit(9999)).cast("int"))).otherwise(F.array().cast("array<int>"))
    first = start.cast("double")
    return F.when((times >= 0) & (times < 10000), F.aggregate(steps, F.array(first), lambda acc, i: F.array_append(acc, F.element_at(acc, -1) * by)))


@op("number", "list<int>")
def range_(n):
    top = F.floor(n).cast("bigint")
    return F.when(top >= 1, F.sequence(F.lit(1).cast("bigint"), F.greatest(top, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))


# ---- reducers


@op("list<number>", "number")
def reduce_sum(v):
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


@op("list<number>", "number")
def reduce_min(v):
    """Fails for an empty list; NaN if there is one."""
    return F.when(F.exists(v, lambda x: F.isnan(x.cast("double"))), F.array_max(v)).otherwise(F.array_min(v))


@op("list<number>", "number")
def reduce_max(v):
    return F.array_max(v)


@op("list<number>", "int")
def reduce_argmin(v):
    return F.array_position(v, reduce_min(v))


@op("list<number>", "int")
def reduce_argmax(v):
    return F.array_position(v, F.array_max(v))


@op("list", "int")
def reduce_length(v):
    return F.size(v).cast("bigint")


# ---- pairs


def pair(a: Column, b: Column) -> Column:
    return F.struct(a.alias("_1"), b.alias("_2"))


@op("list list", "pairs")
def vector_of_products(a, b):
    """All pairs, the first list fastest."""
    return F.flatten(F.transform(b, lambda y: F.transform(a, lambda x: pair(x, y))))


@op("list", "pairs")
def vector_of_combinations(v):
    """Pairs of values at i < j; fails for an empty list."""
    return F.when(F.size(v) > 0, F.flatten(F.transform(v, lambda x, i: F.transform(F.slice(v, i + 2, F.size(v)), lambda y: pair(x, y)))))


@op("list list", "pairs")
def mappings_a_to_b(a, b):
    """Pairs by position, as many as the shorter list has."""
    n = F.least(F.size(a), F.size(b))
    return F.transform(F.slice(a, F.lit(1), n), lambda x, i: pair(x, F.get(b, i)))
