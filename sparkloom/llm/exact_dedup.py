"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpoint, text_or_empty, with_columns

#: Bytes that one surviving (length, prefix hash) key takes in a broadcast table, and the size up to which it is broadcast.
KEY_BYTES, BROADCAST_BYTES = 64, 64 << 20


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark the row that stays of each group of equal texts.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The rows of a group get
    ``keep_id`` (its largest id), ``group_size`` and ``kept``. Lengths are counted first: rows whose length nobody shares
    drop out before any hash. Prefixes are hashed and counted among the rest, and the full text is hashed only where
    length and prefix hash repeat. Each stage gathers counts, never rows; the lengths and the keys that are left are
    broadcast while they take at most ``broadcast_bytes``, beyond it rows' hashes meet them in a shuffle join.

    Nulls: a null id never wins against another id; a group of null ids alone has a null keep_id and keeps its rows.
    Rows that repeat id and text are one document: they count in group_size and are kept or dropped together.
    Empty table: empty result. Input columns named like an output column are replaced; others pass through.
    """
    raw, norm = text_or_empty(text_col), ascii_lower(text_or_empty(text_col))
    lengths = checkpoint(docs.groupBy(F.length(raw).alias("__n1")).agg(F.count("*").alias("rows")).where("rows > 1").select("__n1"))
    few = lengths.count() * KEY_BYTES <= broadcast_bytes
    prefix = ascii_lower(F.substring(raw, 1, prefix_chars))
    shared = docs.select(F.length(raw).alias("n"), prefix.alias("t")).join(F.broadcast(lengths) if few else lengths, F.col("n") == F.col("__n1"), "left_semi")
    counts = shared.groupBy("n", F.xxhash64("t").alias("p")).count()
    keys = checkpoint(counts.where("count > 1").select(F.col("n").alias("__n"), F.col("p").alias("__p"), F.lit(True).alias("__left")))

    marked = docs.withColumn("__len", F.length(raw))
    if few:  # rows of a length of their own have no prefix hash, and so no key
        marked = marked.join(F.broadcast(lengths), F.col("__len") == F.col("__n1"), "left").withColumn("__pre", F.when(F.col("__n1").isNotNull(), F.xxhash64(prefix))).drop("__n1")
    else:
        marked = marked.withColumn("__pre", F.xxhash64(prefix))
    on = (F.col("__len") == F.col("__n")) & (F.col("__pre") == F.col("__p"))
    if keys.count() * KEY_BYTES <= broadcast_bytes:
        marked = marked.join(F.broadcast(keys), on, "left")
        full = F.when(F.col("__left"), F.sha2(norm, 256))
    else:  # the hash of every row goes into the shuffle, so that no text does
        marked = marked.withColumn("__sha", F.sha2(norm, 256)).join(keys, on, "left")
        full = F.when(F.col("__left"), F.col("__sha"))
    marked = marked.withColumn("__full", full)
    groups = marked.where("__left").groupBy("__full").agg(F.max(id_col).alias("__keep"), F.count("*").alias("__size")).where("__size > 1").withColumnRenamed("__full", "__group")
    # Rows of no group get a key of their own, so that they spread over the join's partitions.
    own = F.concat(F.lit("-"), F.xxhash64(id_col, F.col("__len")).cast("string"))
    joined = marked.withColumn("__key", F.coalesce("__full", own)).join(groups, F.col("__key") == F.col("__group"), "left")
    keep = F.when(F.col("__group").isNull(), F.col(id_col)).otherwise(F.col("__keep"))
    out = with_columns(joined, {"keep_id": keep, "group_size": F.coalesce("__size", F.lit(1)).cast("long"), "kept": keep.eqNullSafe(F.col(id_col))})
    return out.drop("__len", "__pre", "__n", "__p", "__left", "__sha", "__full", "__group", "__keep", "__size", "__key")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that exact_dedup keeps, with the columns of docs."""
    return exact_dedup(docs, id_col, text_col).where("kept").select(*[f"`{c}`" for c in docs.columns])
