"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, text_or_empty, with_columns

#: Hexadecimal digits of the hash that split the documents of one source and size class.
SUB_DIGITS = 2


def n_words(text_col: str = "text") -> Column:
    """Words in a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source_col: str) -> Column:
    """Not null, in the order of the source's code points, with null last."""
    return F.when(F.col(source_col).isNull(), "z").otherwise(F.concat(F.lit("a"), F.col(source_col)))


def _size_class(size: Column) -> Column:
    """Integer that grows with the size: its bit length and its five leading bits."""
    bits = F.length(F.bin(size))
    return bits * 32 + F.call_function("shiftright", size, F.greatest(bits - 5, F.lit(0)))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target of each source, from one row (key, source_size) per source.

    The sources, by key, weigh ``weights`` in turn and divide ``share`` times the sum of sizes. A target stops at
    ``most`` times its source's size; what is over goes to the others by weight, until none is above. That is water
    filling: in the order of size over weight the first sources are full, and the rest share what is left.
    """
    by_key, by_ratio = Window.orderBy("key"), Window.orderBy("ratio", "key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weighed = sizes.withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[(F.row_number().over(by_key) - 1) % len(weights)])
    weighed = weighed.withColumn("ratio", F.col("source_size") / F.col("weight"))
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    left = total - F.lit(float(most)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    full = weighed.withColumns({"total": total, "full": left / rest * F.col("weight") >= F.lit(float(most)) * F.col("source_size")})
    over = F.col("total") - F.lit(float(most)) * F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size"))).over(everything), F.lit(0))
    level = over / F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.lit(float(most)) * F.col("source_size")).otherwise(level * F.col("weight"))
    return full.select("key", "source_size", target.alias("target"))


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42, size_col: str | None = None) -> DataFrame:
    """docs with ``size``, ``source_size``, ``target`` and ``copies``, the times that the mix takes each document.

    A document's expected copies are its source's target over its size. Within a source the documents stand by size
    class and hash; their expected copies add up along that order, one random offset is added, and a document is
    taken once for each integer that its share of the sum crosses. Neighbours in this order are alike in size, so the
    words taken stay near the target. Rank within a source = rows in earlier groups + rank in its own small group,
    so that no task holds a source.

    docs is read twice. Where it has its sizes already, size_col names them, and the texts aren't read.

    Nulls: a null text has size 0; null sources are one source, last in order; a null id counts as an empty text.
    A source without words has target 0 and is not taken. Repeated rows are documents of their own. Reruns agree.
    Empty table: empty result. Input columns named like an output column are replaced; others pass through.
    """
    noise = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.withColumns({"__key": _source_key(source_col), "__size": F.coalesce(F.col(size_col).cast("long"), F.lit(0).cast("long")) if size_col else n_words(text_col), "__noise": noise})
    rows = rows.withColumns({"__class": _size_class(F.col("__size")), "__sub": F.substring("__noise", 1, SUB_DIGITS)})
    group = ["__key", "__class", "__sub"]
    counts = rows.groupBy(*group).agg(F.count("*").alias("__rows"), F.sum("__size").alias("__words"))
    targets = source_targets(counts.groupBy(F.col("__key").alias("key")).agg(F.sum("__words").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy("__key").orderBy("__class", "__sub").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("__base", F.coalesce(F.sum("__rows").over(earlier), F.lit(0))).join(targets, F.col("__key") == F.col("key")).select(*group, "__base", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*group).orderBy("__noise", id_col))).join(base, group)
    each = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(0.0)
    offset = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("__key"))), 1, 4), 16, 10).cast("long") + 0.5) / 65536.0
    upto = lambda rank: F.floor(each * rank + offset)
    rank = F.col("__base") + F.col("__rank")
    out = with_columns(ranked, {"size": F.col("__size"), "source_size": F.col("__source_size"), "target": F.col("__target"), "copies": (upto(rank) - upto(rank - 1)).cast("long")})
    return out.drop(*group, "__size", "__noise", "__rank", "__base", "__source_size", "__target")


def mix(docs: DataFrame, **params) -> DataFrame:
    """The mixed corpus: each document as often as mix_counts takes it, with the columns of docs."""
    taken = mix_counts(docs.withColumn("__row", F.struct(*[docs[f"`{c}`"] for c in docs.columns])), **params).where("copies > 0")
    repeated = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
