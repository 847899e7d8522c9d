"""A store of sub-programs: tables of slot definitions by environment, slot and version, and of the individuals that need them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.program import Call, Node, Sharing, dump_nodes, load_nodes, steps
from ..plans.slots import Slot, SlotError, Slots
from ..registry import REGISTRY, Registry

NEEDS = "array<struct<slot:string,version:int>>"
DEFINITIONS = f"environment string, slot string, version int, title string, params array<string>, returns string, body string, fixed boolean, dependencies {NEEDS}, digest string"
INDIVIDUALS = f"environment string, individual string, outputs string, needs {NEEDS}"


class UnknownDependency(SlotError):
    """A definition or an individual needs a slot version that isn't stored."""


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def definitions(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, f"{path}/definitions", DEFINITIONS)


def individuals(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, f"{path}/individuals", INDIVIDUALS)


def missing_dependencies(spark: SparkSession, path: str) -> DataFrame:
    """(environment, slot, version): what some definition or individual needs and isn't stored."""
    stored = definitions(spark, path)
    needed = [t.select("environment", F.explode(c).alias("n")).select("environment", "n.slot", "n.version") for t, c in ((stored, "dependencies"), (individuals(spark, path), "needs"))]
    return needed[0].unionByName(needed[1]).distinct().join(stored, ["environment", "slot", "version"], "left_anti")


def latest(spark: SparkSession, path: str, environment: str) -> dict[str, tuple[int, str]]:
    """slot: (version, digest) of the newest definitions of an environment."""
    rows = definitions(spark, path).where(F.col("environment") == environment).groupBy("slot").agg(F.max(F.struct("version", "digest")).alias("d")).select("slot", "d.version", "d.digest").collect()
    return {r["slot"]: (r["version"], r["digest"]) for r in rows}


def save(spark: SparkSession, slots: Slots, path: str, environment: str) -> dict[str, int]:
    """Append the definitions of all slots and return their versions.

    A slot gets a new version when its title, types, body or the version of a slot that it calls has changed; an equal
    one keeps its version and isn't written again. Old versions stay. One writer an environment at a time.
    """
    known, versions, rows = latest(spark, path, environment), {}, []
    for slot in slots.in_order():
        needs = sorted((n, versions[n]) for n in slots.dependencies(slot.name))
        body = None if slot.empty else dump_nodes([slot.body])
        digest = hashlib.sha256(json.dumps([slot.title, slot.params, slot.returns, body, slot.fixed, needs]).encode()).hexdigest()
        version, last = known.get(slot.name, (0, ""))
        if digest != last:
            version += 1
            rows.append((environment, slot.name, version, slot.title, list(slot.params), slot.returns, body, slot.fixed, needs, digest))
        versions[slot.name] = version
    if rows:
        spark.createDataFrame(rows, DEFINITIONS).coalesce(1).write.mode("append").parquet(f"{path}/definitions")
    return versions


def _closure(spark: SparkSession, path: str, environment: str, wanted: set[tuple[str, int]]) -> dict[tuple[str, int], dict]:
    """The definitions that some versions reach, level by level; each level is one query for the versions asked for."""
    stored, found, level = definitions(spark, path).where(F.col("environment") == environment), {}, set(wanted)
    while level:
        asked = spark.createDataFrame(sorted(level), "slot string, version int")
        rows = {(r["slot"], r["version"]): r.asDict(recursive=True) for r in stored.join(F.broadcast(asked), ["slot", "version"]).collect()}
        if lost := level - rows.keys():
            raise UnknownDependency(", ".join(f"{environment}/{s} version {v}" for s, v in sorted(lost)))
        found |= rows
        level = {(d["slot"], d["version"]) for r in rows.values() for d in r["dependencies"]} - found.keys()
    return found


def load(spark: SparkSession, path: str, environment: str, versions: Mapping[str, int] | None = None, base: Registry = REGISTRY) -> Slots:
    """The slots of an environment at some versions, by default the newest of each.

    What they call comes along at the version that they were saved with; where that isn't the version asked for, it is
    a fixed slot named slot@version. Refused: a version that isn't stored, asked for or needed.
    """
    versions = dict(versions) if versions is not None else {s: v for s, (v, _) in latest(spark, path, environment).items()}
    found = _closure(spark, path, environment, set(versions.items()))
    name_of = {(s, v): s if versions.get(s) == v else f"{s}@{v}" for s, v in found}
    slots, done = Slots(base), set()

    def put(key: tuple[str, int]) -> None:
        if key in done:
            return
        done.add(key)
        row, sharing = found[key], Sharing()
        calls = {d["slot"]: (d["slot"], d["version"]) for d in row["dependencies"]}
        for k in sorted(calls.values()):
            put(k)
        body = None
        if row["body"] is not None:
            body = sharing.rebuild(load_nodes(row["body"]), lambda c, args: Call(name_of[calls[c.op]] if c.op in calls else c.op, args, c.type))[0]
            for c in steps([body]):
                slots.registry.resolve(c.op, [a.type for a in c.args])
        slots._put(Slot(name_of[key], tuple(row["params"]), row["returns"], body, row["title"], row["fixed"] or name_of[key] != key[0]))

    for key in sorted(found):
        put(key)
    return slots


def save_individual(spark: SparkSession, slots: Slots, path: str, environment: str, individual: str, outputs: Sequence[Node]) -> None:
    """Append an individual with the versions of the slots that it calls. Refused: a slot whose present definition isn't stored."""
    versions = stored_versions(spark, slots, path, environment)
    used = sorted(slots.used(outputs))
    if lost := [n for n in used if n not in versions]:
        raise UnknownDependency(f"save the environment first: {', '.join(lost)}")
    row = (environment, individual, dump_nodes(outputs), [(n, versions[n]) for n in used])
    spark.createDataFrame([row], INDIVIDUALS).coalesce(1).write.mode("append").parquet(f"{path}/individuals")


def stored_versions(spark: SparkSession, slots: Slots, path: str, environment: str) -> dict[str, int]:
    """The stored versions of the slots whose present definition is the newest stored one."""
    stored = {r["slot"]: r for r in _newest(spark, path, environment)}
    same = lambda s, r: r["body"] == (None if s.empty else dump_nodes([s.body])) and tuple(r["params"]) == s.params
    return {n: stored[n]["version"] for n, s in slots.slots.items() if n in stored and same(s, stored[n])}


def _newest(spark: SparkSession, path: str, environment: str) -> list:
    return definitions(spark, path).where(F.col("environment") == environment).groupBy("slot").agg(F.max("version").alias("version"), F.max_by("body", "version").alias("body"), F.max_by("params", "version").alias("params")).collect()


def load_individual(spark: SparkSession, path: str, environment: str, individual: str, base: Registry = REGISTRY) -> tuple[list[Node], Slots]:
    """The newest program saved under a name, and the slots at the versions that it was saved with."""
    rows = individuals(spark, path).where((F.col("environment") == environment) & (F.col("individual") == individual)).collect()
    if not rows:
        raise UnknownDependency(f"{environment}/{individual}")
    row = rows[-1]
    return load_nodes(row["outputs"]), load(spark, path, environment, {d["slot"]: d["version"] for d in row["needs"]}, base)

