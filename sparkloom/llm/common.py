"""Helpers shared by the corpus operators: folders all executors see, text columns, word tables."""

from __future__ import annotations

import string
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: What str.split() takes for white space beside ASCII's.
WIDE_SPACE = "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a session on one machine may name none, as in tests; a temporary folder is set for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        base = sc._jsc.sc().getCheckpointDir()
        if base.isDefined():
            return base.get()
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sparkloom-")
        sc.setCheckpointDir(base)
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def with_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns; one of the same name, in any letter case, is replaced."""
    names = {c.lower() for c in columns}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in names], *[v.alias(k) for k, v in columns.items()])


def crc32_of(id_col: str) -> Column:
    """crc32 of the id written as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


_memo: dict = {}


def remembered(key, make):
    """What make() gives, kept in this worker until another operator asks for its own: a worker holds one operator's memory at a time."""
    if _memo.get("key") != key:
        _memo.clear()
        _memo.update(value=make(), key=key)
    return _memo["value"]


def slices(texts: pa.Array, most_bytes: int = 8 << 20):
    """(first row, rows) slices of a batch whose texts hold about most_bytes at most; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most_bytes:
            yield start, i - start
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield start, len(sizes) - start


def words_of(texts: pa.Array, wide: bool = False):
    """The ASCII-white-space words of each text, as (row of each word, code of each word, distinct words); with ``wide`` those of str.split()."""
    texts = pc.fill_null(texts, "")
    if wide:
        some = pc.match_substring_regex(texts, WIDE_SPACE)
        if pc.any(some, min_count=0).as_py():
            texts = pc.replace_with_mask(texts, some, pc.replace_substring_regex(texts.filter(some), WIDE_SPACE, " "))
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    flat = lists.flatten()
    keep = pc.not_equal(flat, "")
    if not pc.all(keep, min_count=0).as_py():
        mask = keep.to_numpy(zero_copy_only=False)
        rows, flat = rows[mask], flat.filter(keep)
    coded = flat.dictionary_encode()
    # By way of numpy: to_pylist makes a scalar object of each word first.
    return rows, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
