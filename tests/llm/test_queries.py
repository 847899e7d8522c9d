"""The registered queries against DuckDB, and the pipeline against its stages done by hand."""

from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from sparkloom.llm import decontam, langid, mixing, queries, simhash

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(cursor.fetchall())


def test_every_operator_has_its_query():
    names = __spark_entry__.queries()
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)] and set(queries.QUERIES) | {"pipeline"} <= set(names)


def test_pipeline_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    local = [r for r in langid.identify(docs, model).collect() if r["lang_pred"] != "und" and r["lang_score"] >= 0.5]
    prints = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in local}
    ids = sorted(prints)
    gone = set()
    for i in ids:  # everything that is reached from i over links of three bits goes
        queue = [i] if i not in gone else []
        seen = set(queue)
        while queue:
            a = queue.pop()
            for b in ids:
                if b not in seen and (prints[a] ^ prints[b]).bit_count() <= 3:
                    seen.add(b)
                    queue.append(b)
        gone |= seen - {i}
    left = [r for r in local if r["doc_id"] not in gone]
    items = [[w for x in r["text"].split() if (w := decontam.normal(x))] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(text):
        words = " ".join(w for x in text.split() if (w := decontam.normal(x)))
        return any(f" {' '.join(i)} " in f" {words} " for i in items)

    left = [r for r in left if not leaks(r["text"])]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_counts(spark.createDataFrame([r["doc_id"] for r in left], "long").withColumnRenamed("value", "doc_id").join(docs, "doc_id")).collect()}
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, want, start = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))), [], 0
    for r in sorted(left, key=lambda r: r["doc_id"]):
        data = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2]
        for _ in range(copies[r["doc_id"]]):
            want.append((r["doc_id"], start, len(data), crc32(np.array(data, "<u4").tobytes())))
            start += len(data)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted(want) and len(want) > 100
