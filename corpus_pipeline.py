"""A training-data pipeline over the documents table, stage by stage; every stage is written and read again.

1. language: documents without a sure language go.
2. near_dedup: of documents within three bits of SimHash one stays.
3. decontaminate: documents that hold a benchmark item go.
4. mix: documents repeat or drop out so that sources meet their target weights.
5. tokens: what is left is tokenised, written as range-coded frames and read back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontam, langid, mixing, simhash, token_store
from sparkloom.llm.common import shared_path, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents of its own input and keeps the documents that it can tell the language of."""
    return langid.keep_identified(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_store.write_tokens(docs, str(public_tokenizers.path("word_bpe_49k.json")), path)
    return token_store.token_index(spark, path)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: SQL can't express the trained language model, SimHash, alignment or the token files.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
