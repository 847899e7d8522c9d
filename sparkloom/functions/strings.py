"""Operators on strings. Positions count characters from 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import op


def _put(s: Column, at: Column, piece: Column) -> Column:
    return F.concat(F.left(s, at - 1), piece, F.substring(s, at + F.length(piece), F.length(s)))


def _quoted(s: Column) -> Column:
    """s as a literal pattern."""
    return F.concat(F.lit("\\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _number_text(x: Column) -> Column:
    """Exponents in lower case."""
    return F.replace(x.cast("string"), F.lit("E"), F.lit("e"))


@op("", "string")
def empty_string():
    return F.lit("")


@op("number", "string", also=["parse_number"])
def number_to_string(x):
    return _number_text(x)


def _cased(case) -> None:
    """The upper-case and lower-case family."""
    word = "uppercase" if case is F.upper else "lowercase"

    @op("string", "string", name=f"{word}_")
    def whole(s):
        return case(s)

    @op("string number", "string", name=f"{word}_at")
    def at(s, i):
        """One character; the position is truncated, then held inside the string."""
        i = F.greatest(F.lit(1), F.least(F.length(s), i.cast("int")))
        return F.when(F.length(s) > 0, _put(s, i, case(F.substring(s, i, F.lit(1)))))

    @op("string string", "string", name=f"{word}_after")
    def after(s, marker):
        """What follows the first marker."""
        p = F.call_function("instr", s, marker)
        end = p + F.length(marker)
        return F.when((marker == "") | (p == 0), s).otherwise(F.concat(F.left(s, end - 1), case(F.substring(s, end, F.length(s)))))

    @op("string string", "string", name=f"{word}_before")
    def before(s, marker):
        """What stands before the last marker."""
        back = F.call_function("instr", F.reverse(s), F.reverse(marker))
        p = F.length(s) - back - F.length(marker) + 2
        return F.when((marker == "") | (back == 0), s).otherwise(F.concat(case(F.left(s, p - 1)), F.substring(s, p, F.length(s))))

    @op("string string", "string", name=f"{word}_char_after")
    def char_after(s, marker):
        """The character after each marker, from the left, markers apart."""
        parts = F.split(s, _quoted(marker), -1)
        rest = F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(case(F.left(x, F.lit(1))), F.substring(x, F.lit(2), F.length(x)))))
        return F.when((marker == "") | (s == ""), s).otherwise(_join(rest, marker))

    @op("string string", "string", name=f"{word}_char_before")
    def char_before(s, marker):
        """The character before each marker."""
        parts = F.split(s, _quoted(marker), -1)
        last = F.size(parts) - 1
        rest = F.transform(parts, lambda x, i: F.when((i == last) | (x == ""), x).otherwise(F.concat(F.left(x, F.length(x) - 1), case(F.right(x, F.lit(1))))))
        return F.when((marker == "") | (s == ""), s).otherwise(_join(rest, marker))


def _join(parts: Column, by: Column) -> Column:
    return F.call_function("array_join", parts, by)


for _case in (F.upper, F.lower):
    _cased(_case)


@op("string", "string")
def capitalize_first(s):
    return F.concat(F.upper(F.left(s, F.lit(1))), F.substring(s, F.lit(2), F.length(s)))


def title(s: Column) -> Column:
    """Every run of letters starts in upper case and goes on in lower case."""
    pieces = F.regexp_extract_all(s, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(pieces, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, F.lit(2), F.length(x))))), "")


@op("string", "string")
def capitalize_all(s):
    return title(s)


@op("string number", "string")
def if_string(s, cond):
    """s where cond, truncated, isn't 0; else empty."""
    return F.when(cond.cast("bigint") != 0, s).otherwise("")


@op("string number", "string")
def if_not_string(s, cond):
    return F.when(cond.cast("bigint") == 0, s).otherwise("")


@op("string string number", "string")
def if_else_string(a, b, cond):
    return F.when(cond.cast("bigint") != 0, a).otherwise(b)


@op("string string", "string")
def longest_string(a, b):
    return F.when(F.length(a) >= F.length(b), a).otherwise(b)


@op("string string", "string")
def shortest_string(a, b):
    return F.when(F.length(a) <= F.length(b), a).otherwise(b)


@op("string string string", "string")
def replace_pattern(s, old, new):
    """All literal matches; an empty pattern matches at every boundary."""
    spread = F.concat(new, _join(F.split(s, F.lit(""), -1), new), new)
    return F.when(old != "", F.replace(s, old, new)).otherwise(F.when(s == "", new).otherwise(spread))


@op("string string string", "string")
def replace_first_pattern(s, old, new):
    p = F.call_function("instr", s, old)
    end = p + F.length(old)
    return F.when(old == "", F.concat(new, s)).when(p == 0, s).otherwise(F.concat(F.left(s, p - 1), new, F.substring(s, end, F.length(s))))


@op("string string", "string")
def remove_pattern(s, old):
    return F.when(old == "", s).otherwise(F.replace(s, old, F.lit("")))


@op("string string string", "string")
def paste(a, b, sep):
    return F.concat(a, sep, b)


@op("string string", "string")
def paste0(a, b):
    return F.concat(a, b)


@op("string string", "string")
def paste_with_space(a, b):
    return F.concat(a, F.lit(" "), b)


@op("list<string>", "string")
def paste_space_list_string(v):
    return F.array_join(v, " ")


@op("list<string> string", "string")
def paste_list_string_sep(v, sep):
    return _join(v, sep)


@op("list<string>", "string")
def paste_list_string(v):
    return F.array_join(v, "")


@op("string string", "list<string>")
def split_string_to_vector(s, by):
    """By a literal; an empty one splits into characters."""
    return F.when(by == "", F.when(s == "", F.array(F.lit(""))).otherwise(F.split(s, "", -1))).otherwise(F.split(s, _quoted(by), -1))


@op("list<string>", "list<string>")
def reverse_broadcast(v):
    return F.transform(v, lambda s: F.reverse(s))


@op("list<number>", "list<string>")
def numbers_to_string(v):
    return F.transform(v, _number_text)


@op("list<string>", "list<string>")
def capitalize_list_string(v):
    return F.transform(v, title)


@op("list<string>", "list<string>")
def uppercasefirst_list_string(v):
    return F.transform(v, capitalize_first)


@op("string string", "list<int>")
def match_with_overlap(s, pattern):
    """Where the pattern starts, overlapping matches too."""
    at = F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)))
    return F.when((s == "") | (pattern == ""), F.array().cast("array<bigint>")).otherwise(F.filter(at, lambda i: F.substring(s, i, F.length(pattern)) == pattern).cast("array<bigint>"))


@op("list<string>", "list<int>")
def parse_from_list_string(v):
    """Floors of the numbers; fails if one can't be read."""
    read = F.transform(v, lambda s: F.floor(s.try_cast("double")).cast("bigint"))
    return F.when(F.forall(read, lambda x: x.isNotNull()), read)


@op("list<string>", "list<int>")
def length_broadcast(v):
    return F.transform(v, lambda s: F.length(s).cast("bigint"))


@op("string", "int", name="reduce_length")
def string_length(s):
    return F.length(s).cast("bigint")
