"""URL filters as a sort-merge range join over reversed-host keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower

#: Sorted runs that the urls are dealt to; every run sweeps all rules, so no host decides the size of a task.
RUNS = 512


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _rest(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def reversed_host(host: Column) -> Column:
    """Labels from the last to the first, a dot after each: the subdomains of a host are the keys that start with its key."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Rules from (verdict, "host/path") pairs."""
    rows = [(v, r, r.partition("/")[0].lower(), "/" + r.partition("/")[2]) for v, r in rules]
    return spark.createDataFrame(rows, "verdict string, rule string, host string, path string")


def _events(rules: DataFrame) -> DataFrame:
    """Rows (key, stack): from this key on, in key order, the rules of stack are active, outermost hosts first."""
    keyed = rules.where("host is not null").select(reversed_host(F.col("host")).alias("key"), F.struct(F.length("rule").alias("n"), "rule", "path", "verdict").alias("r"))
    hosts = keyed.groupBy("key").agg(F.sort_array(F.collect_set("r")).alias("own"))
    labels = F.split(F.expr("left(key, length(key) - 1)"), r"\.", -1)
    prefix = lambda i: F.concat(F.array_join(F.slice("labels", 1, i), "."), F.lit("."))
    outer = hosts.withColumn("labels", labels).select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), prefix)).alias("around"))
    nested = outer.join(hosts.withColumnRenamed("key", "around"), "around")
    by_depth = lambda c: F.flatten(F.transform(F.sort_array(F.collect_list(F.when(c, F.struct(F.length("around").alias("n"), "own")))), lambda x: x["own"]))
    stacks = nested.groupBy("key").agg(by_depth(F.lit(True)).alias("stack"), by_depth(F.col("around") != F.col("key")).alias("outer"))
    # "/" follows "." in byte order: keys that start with a host's key end where the key with "/" for its last dot stands.
    return stacks.select(F.explode(F.array(F.struct("key", "stack"), F.struct(F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/")).alias("key"), F.col("outer").alias("stack")))).alias("e")).select("e.*")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", runs: int = RUNS) -> DataFrame:
    """pages with ``host``, ``path``, ``rule`` and ``verdict``.

    rules: verdict, rule, host, path. A rule fits its host and all subdomains where the url's path starts with its
    path; the longest rule wins, then the smaller text. Rule hosts become intervals of reversed-host keys. Starts and
    ends of intervals are sorted in among the urls, and a running value along that order is the stack of rules that
    are active at a url; only those few are compared with its path. Urls are dealt by hash to ``runs`` sorted runs,
    each of which gets all interval ends: what is copied is 2 x runs rows for a rule, whatever the urls are.

    Nulls: a null url, or one without ://, has an empty host and path and no rule. Without a rule the verdict is
    ``default``. Repeated rows are judged alike. No rules or no pages: defined, nothing fits. Input columns named like
    an output column are replaced; others pass through.
    """
    urls = pages.select(F.struct(*[pages[f"`{c}`"] for c in pages.columns]).alias("row"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.pmod(F.xxhash64(id_col, url_col), F.lit(runs)).cast("int").alias("run"))
    urls = urls.withColumns({"key": reversed_host(F.col("host")), "last": F.lit(1)})
    marks = _events(rules).withColumns({"run": F.explode(F.sequence(F.lit(0), F.lit(runs - 1))), "last": F.lit(0)})
    swept = urls.unionByName(marks, allowMissingColumns=True).withColumn("active", F.last("stack", ignorenulls=True).over(Window.partitionBy("run").orderBy("key", "last").rowsBetween(Window.unboundedPreceding, 0))).where("last = 1")
    fitting = F.filter("active", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.reduce(fitting, F.lit(None).cast("struct<n:int,rule:string,path:string,verdict:string>"), lambda a, r: F.when(a.isNull() | (r["n"] > a["n"]) | ((r["n"] == a["n"]) & (r["rule"] < a["rule"])), r).otherwise(a))
    judged = swept.withColumn("best", best)
    return judged.select(*[F.col("row").getField(c).alias(c) for c in pages.columns if c.lower() not in {"host", "path", "rule", "verdict"}], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
