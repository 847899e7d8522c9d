"""Operators on booleans and numbers. NULL means that the operation failed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import op


def is_nan(x: Column) -> Column:
    return F.isnan(x.cast("double"))


def mask(condition: Column) -> Column:
    return condition.cast("bigint")


@op("bool", "bool", also=["identity_int", "identity_float", "identity_str"], family="identity")
def identity_bool(x):
    """The value itself."""
    return x


@op("", "bool")
def ret_true():
    return F.lit(True)


@op("", "bool")
def ret_false():
    return F.lit(False)


@op("string", "bool", name="parse_string", fallback=False)
def parse_bool(s):
    """True for the literal true; everything else, and what can't be read, is false."""
    return F.trim(s) == "true"


@op("number any any", "any")
def if_else_multiplexer(cond, a, b):
    """a where cond > 0, else b."""
    return F.when((cond > 0) & ~is_nan(cond), a).otherwise(b)


@op("", "int")
def ret_1():
    return F.lit(1).cast("bigint")


@op("number", "float")
def tanh(x):
    return F.tanh(x)


@op("number", "float")
def relu(x):
    """x where positive, else 0; NaN gives 0."""
    return F.when((x > 0) & ~is_nan(x), x).otherwise(F.lit(0))


@op("number number", "int", name="is_eq_to")
def number_is_eq_to(n, to):
    return mask((n == to) & ~is_nan(n))


@op("string", "int")
def str_is_empty(s):
    return mask(s == "")


@op("number number", "int")
def experimental_is_gt(n, than):
    return mask((n > than) & ~is_nan(n) & ~is_nan(than))


@op("number number", "int")
def experimental_is_lt(n, than):
    return mask((n < than) & ~is_nan(n) & ~is_nan(than))


@op("number", "int")
def experimental_not(n):
    return mask(n <= 0.5)


@op("number number", "number")
def modulo(a, b):
    """Remainder with the sign of a; fails for b = 0."""
    return F.try_mod(a, b)


@op("number number", "number")
def number_sum(a, b):
    return F.try_add(a, b)


@op("number number", "number")
def number_minus(a, b):
    return F.try_subtract(a, b)


@op("number number", "number")
def number_mult(a, b):
    return F.try_multiply(a, b)


@op("number number", "float")
def number_div(a, b):
    """Fails for b = 0."""
    return F.try_divide(a, b)


@op("number number", "float")
def safe_div(a, b):
    """b where b = 0."""
    return F.when(b == 0, b.cast("double")).otherwise(F.try_divide(a, b))


@op("number number", "float")
def power_of(a, b):
    """Fails where the power isn't a real number."""
    p = F.pow(a, b)
    return F.when(~F.isnan(p) | is_nan(a) | is_nan(b), p)


@op("", "float")
def pi_():
    return F.pi()


@op("number", "float")
def exp_(a):
    return F.exp(a)


@op("number", "float")
def log_(a):
    """Natural logarithm of a, held above 1e-10."""
    return F.log(F.greatest(a.cast("double"), F.lit(1e-10)))


@op("number", "float")
def log10_(a):
    return F.log10(F.greatest(a.cast("double"), F.lit(1e-10)))
