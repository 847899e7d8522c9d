"""Samples, node and edge tables, the record of generations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a session on one machine may name none and gets a temporary one."""
    base, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not base:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sparkloom-")
        sc.setCheckpointDir(base)
    return base


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def samples(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def split(df: DataFrame, shares: tuple[float, ...] = (0.7, 0.15, 0.15), seed: int = 0) -> list[DataFrame]:
    return df.randomSplit(list(shares), seed)


def batched(df: DataFrame, key: str, batches: int, seed: int = 0) -> DataFrame:
    """df with ``batch``, 0 to batches - 1, by a seeded hash of the key: about equal parts, the same in every run, without a shuffle."""
    if batches < 1:
        raise ValueError("at least one batch")
    return df.withColumn("batch", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(batches)).cast("int"))


def check_columns(df: DataFrame, wanted: list[str]) -> None:
    if df.columns != wanted:
        raise ValueError(f"columns {df.columns} are not {wanted}")


def new_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new whose id_hash isn't in nodes, one for each."""
    return new.join(nodes.select("id_hash"), "id_hash", "left_anti").dropDuplicates(["id_hash"])


def append_nodes(spark: SparkSession, path: str, new: DataFrame) -> None:
    nodes = spark.read.parquet(path)
    check_columns(new, nodes.columns)
    new_nodes(nodes, new).write.mode("append").parquet(path)


def append_edges(path: str, edges: DataFrame) -> None:
    check_columns(edges.select(*edges.columns[:3]), ["_from", "_to", "iteration"])
    edges.write.mode("append").parquet(path)


def track(record: DataFrame, path: str) -> None:
    """One JSON object per row, appended as lines."""
    record.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def id_hash(*columns: str):
    """One hash of all hash columns of a node."""
    return F.sha2(F.concat_ws("_", *columns), 256)
