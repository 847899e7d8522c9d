"""Recall of decontamination: every pair of document and item against a plain alignment without seeds."""

import random

import pytest

from sparkloom.llm import decontam

SF = "/root/testdata/sf0.001"


def aligned(item, words):
    """Smith-Waterman by cells."""
    above, best = [0.0] * (len(words) + 1), 0.0
    for w in item:
        row = [0.0]
        for k, v in enumerate(words):
            row.append(max(0.0, above[k] + (1.0 if v == w else -decontam.COST), above[k + 1] - decontam.COST, row[k] - decontam.COST))
        best, above = max(best, max(row)), row
    return best


def words_of(text):
    return [w for t in (text or "").split() if (w := decontam.normal(t))]


@pytest.mark.parametrize(("length", "share"), [(15, 0.1), (15, 0.2), (15, 0.3), (30, 0.2), (30, 0.3)])
def test_edited_copies(spark, length, share):
    rng = random.Random(length * 100 + int(share * 100))
    vocabulary = [f"word{i}" for i in range(3000)]
    items = [[rng.choice(vocabulary) for _ in range(length)] for _ in range(120)]
    docs = []
    for item in items:
        copy = []
        for w in item:
            roll = rng.random()
            if roll < share / 3:
                continue
            copy.append(rng.choice(vocabulary) if roll < 2 * share / 3 else w)
            if roll > 1 - share / 3:
                copy.append(rng.choice(vocabulary))
        docs.append([rng.choice(vocabulary) for _ in range(rng.randint(0, 40))] + copy + [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))])
    want = {(i, i) for i, (item, doc) in enumerate(zip(items, docs, strict=True)) if aligned(item, doc) >= decontam.LEAK * length}
    frame = lambda rows, name: spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], f"{name} long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leak_pairs(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert len(want) > 50 and len(got & want) >= 0.9 * len(want) and got <= want


def test_given_documents(spark):
    """Items of the given table against whole documents, where one word in three of an item stands in the document at all."""
    docs = {r["doc_id"]: words_of(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r["item_id"]: words_of(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = set()
    for d, words in docs.items():
        held = set(words)
        for i, item in items.items():
            if len(words) < 4000 and sum(w in held for w in item) >= decontam.LEAK * len(item) and aligned(item, words) >= decontam.LEAK * len(item):
                want.add((d, i))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leak_pairs(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    short = {(d, i) for d, i in got if len(docs[d]) < 4000}
    assert want and short == want
