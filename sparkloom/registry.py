"""Typed operator catalogue: builders of Spark columns, casters, fallbacks and type-directed choice of overloads."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EngineConf:
    """Bounds of values and lists. constrained: lists are cut to small_array values."""

    min_int: int = -1000
    max_int: int = 1000
    min_float: float = -1000.0
    max_float: float = 1000.0
    nano_array: int = 100
    small_array: int = 1000
    big_array: int = 10000
    constrained: bool = False


#: Value types and the Spark types that carry them. Images are column-major.
SPARK_TYPES = {
    "bool": "boolean",
    "int": "bigint",
    "float": "double",
    "string": "string",
    "list<int>": "array<bigint>",
    "list<float>": "array<double>",
    "list<string>": "array<string>",
    "pairs<int>": "array<struct<_1:bigint,_2:bigint>>",
    "pairs<float>": "array<struct<_1:double,_2:double>>",
    "pairs<string>": "array<struct<_1:string,_2:string>>",
    "image": "struct<h:int,w:int,kind:string,pixels:array<double>>",
}

#: Abstract types of parameters and the value types that they accept.
ACCEPTS = {
    "number": {"int", "float", "bool"},
    "list<number>": {"list<int>", "list<float>"},
    "list": {"list<int>", "list<float>", "list<string>"},
    "pairs": {"pairs<int>", "pairs<float>", "pairs<string>"},
    "pairs<number>": {"pairs<int>", "pairs<float>"},
    "any": set(SPARK_TYPES),
}


def accepts(parameter: str, value: str) -> bool:
    return parameter == value or value in ACCEPTS.get(parameter, ())


def clamp(x: Column, lo: Any, hi: Any) -> Column:
    """lo..hi; NaN stays NaN."""
    held = F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    return F.when(F.isnan(x.cast("double")), x).otherwise(held)


def cast_value(x: Column, kind: str | None, conf: EngineConf) -> Column:
    """The caster of a type; NULL where the value can't become one."""
    if kind == "int":
        d = x.cast("double")
        ok = ~F.isnan(d) & (F.abs(d) != float("inf"))
        return F.when(ok, clamp(F.floor(d), conf.min_int, conf.max_int)).cast("bigint")
    if kind == "float":
        return clamp(x.cast("double"), conf.min_float, conf.max_float)
    if kind == "string":
        return x.cast("string")
    if kind == "bool_to_int":
        return x.cast("bigint")
    if kind == "list<int>":
        return F.transform(x, lambda v: F.floor(v).cast("bigint"))
    if kind == "list<float>":
        return F.transform(x, lambda v: v.cast("double"))
    if kind == "list<string>":
        return F.transform(x, lambda v: v.cast("string"))
    return x


@dataclass(frozen=True)
class OpSpec:
    """An operator. build gives NULL where the operation fails; the fallback takes its place."""

    name: str
    family: str
    params: tuple[str, ...]
    returns: str
    build: Callable[..., Column]
    fallback: Any = None
    caster: str | None = None
    doc: str = ""
    defaults: tuple = ()
    #: How a program writes the operator by others, from its argument nodes, so that it can share them; None if it stays.
    lower: Callable[[tuple], Any] | None = None

    def fits(self, types: Iterable[str]) -> bool:
        """Arguments beyond the parameters are ignored; parameters with defaults may be missing."""
        types = list(types)
        if len(types) < len(self.params) - len(self.defaults):
            return False
        return all(accepts(p, t) for p, t in zip(self.params, types, strict=False))

    def column(self, args: list[Column], conf: EngineConf | None = None) -> Column:
        given = list(args[: len(self.params)])
        missing = len(self.params) - len(given)
        given += [F.lit(d) for d in self.defaults[len(self.defaults) - missing :]] if missing else []
        out = self.build(*given)
        if conf is not None:
            out = cast_value(out, self.caster, conf)
            if conf.constrained and self.returns.startswith("list"):
                out = F.slice(out, 1, conf.small_array)
        return out if self.fallback is None else F.coalesce(out, literal(self.fallback, self.returns))


def literal(value: Any, kind: str) -> Column:
    if isinstance(value, (list, tuple)):
        return F.array(*[F.lit(v) for v in value]).cast(SPARK_TYPES.get(kind, "array<string>"))
    return F.lit(value)


@dataclass(eq=False)
class Registry:
    """Operators by name; overloads in the order in which they were registered."""

    ops: dict[str, list[OpSpec]] = field(default_factory=dict)

    def register(self, spec: OpSpec) -> OpSpec:
        self.ops.setdefault(spec.name, []).append(spec)
        return spec

    def op(self, params: str = "", returns: str = "any", name: str | None = None, family: str = "", fallback: Any = None, defaults: tuple = (), also: Iterable[str] = (), lower: Callable[[tuple], Any] | None = None):
        """Decorator: params are space-separated types."""

        def add(build: Callable[..., Column]) -> Callable[..., Column]:
            for n in (name or build.__name__, *also):
                self.register(OpSpec(n, family or build.__module__.rpartition(".")[2], tuple(params.split()), returns, build, fallback, None, (build.__doc__ or "").strip(), defaults, lower))
            return build

        return add

    def resolve(self, name: str, types: Iterable[str]) -> OpSpec:
        """The first overload whose parameters accept the types."""
        types = list(types)
        for spec in self.ops.get(name, ()):
            if spec.fits(types):
                return spec
        raise LookupError(f"no operator {name} for ({', '.join(types)})")

    def __call__(self, name: str, *args: Column, types: Iterable[str] | None = None, conf: EngineConf | None = None) -> Column:
        """The column of an operator; without types, the first overload with room for the arguments."""
        spec = self.resolve(name, types) if types is not None else next(s for s in self.ops[name] if len(s.params) - len(s.defaults) <= len(args))
        return spec.column(list(args), conf)

    def preset(self, returns: str, caster: str | None = None, fallback: Any = None, families: Iterable[str] | None = None) -> Registry:
        """The operators that can return one type, with a caster and a fallback for all of them; in the preset of a value type they return just that."""
        out = Registry()
        for specs in self.ops.values():
            for s in specs:
                if accepts(s.returns, returns) or accepts(returns, s.returns) or s.returns == "any":
                    if families is None or s.family in set(families):
                        out.register(replace(s, returns=s.returns if returns in ACCEPTS else returns, caster=caster or returns, fallback=s.fallback if fallback is None else fallback))
        return out

    def library(self, name: str) -> Registry:
        """One of LIBRARIES."""
        returns, fallback, families, only, without = LIBRARIES[name]
        found = self.preset(returns, None, fallback, families.split())
        keep = lambda n: (not only or n in only.split()) and n not in without.split()
        return Registry({n: specs for n, specs in found.ops.items() if keep(n)})

    def table(self, spark: SparkSession) -> DataFrame:
        """The catalogue as a table."""
        rows = [(s.name, s.family, ", ".join(s.params), s.returns, s.doc) for specs in self.ops.values() for s in specs]
        return spark.createDataFrame(rows, "name string, family string, params string, returns string, doc string")


#: Ready libraries: value type, fallback, families, operators (all of the families if empty), operators left out.
LIBRARIES: dict[str, tuple[str, Any, str, str, str]] = {
    "list_int": ("list<int>", (), "lists strings identity", "", ""),
    "list_float": ("list<float>", (), "lists strings identity", "", ""),
    "list_string": ("list<string>", (), "lists strings identity", "", ""),
    "pairs_int": ("pairs<int>", (), "lists identity", "identity_list new_list vector_of_products vector_of_combinations mappings_a_to_b", ""),
    "pairs_string": ("pairs<string>", (), "lists identity", "identity_list new_list vector_of_products vector_of_combinations mappings_a_to_b", ""),
    "int": ("int", 0, "scalar lists identity", "", "identity_bool identity_float identity_str tanh relu"),
    "float": ("float", 0.0, "scalar lists images identity", "", "identity_bool identity_int identity_str"),
    "float_regression": ("float", 0.0, "scalar identity", "identity_float ret_1 tanh relu modulo is_eq_to str_is_empty experimental_is_gt experimental_is_lt experimental_not number_sum number_minus number_mult number_div safe_div power_of pi_ exp_ log_ log10_", ""),
    "float_graph": ("float", 0.0, "image_graph_part", "", "graph_measure"),
    "string": ("string", "", "strings scalar lists identity", "", "identity_bool identity_int identity_float"),
    "image": ("image", None, "images binarize", "", ""),
    "image_plain": ("image", None, "images", "identity_image2D ones_2D zeros_2D experimental_invert_2D subtract_img2D add_img2D mult_img2D max_img2D min_img2D bsubtract_image2D badd_image2D bmult_image2D", ""),
}

REGISTRY = Registry()
op = REGISTRY.op
