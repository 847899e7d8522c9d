"""Ranked lexical search against scores worked out document by document."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import lexical

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(lexical.TERM, (text or "").translate(LOWER))


def plain(docs, items, k=10):
    bags = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    asked = {}
    for i, text in items:
        asked.setdefault(i, set()).update(terms(text))
    out = set()
    for item, words in asked.items():
        scored = []
        for i, bag, n in bags:
            m = 10 + 90 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in words if t in bag)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out |= {(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)}
    return out


def found(spark, tmp_path, docs, items, build=None, **how):
    path = str(tmp_path / "index")
    lexical.build_index(spark.createDataFrame([(*d, 1) for d in docs], DOCS + ", terms int"), path, **(build or {}))
    rows = lexical.search(spark, path, spark.createDataFrame([(*i, 2) for i in items], ITEMS + ", rank int"), **how).collect()
    got = {tuple(r) for r in rows}
    assert len(got) == len(rows)
    return got


def invented(seed, n):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["Über", "日本", "naïve", "A1"]
    weights = 1 / np.arange(1, len(words) + 1)
    return [(i, " -.,\n"[rng.integers(5)].join(rng.choice(words, rng.integers(0, 40), p=weights / weights.sum()))) for i in range(n)]


@pytest.mark.parametrize("build", [None, {"block_docs": 7}, {"block_bytes": 200}])
def test_against_every_document(spark, tmp_path, build):
    docs = invented(1, 400) + [(1000 + i, "w3 w9 copy of copies") for i in range(60)] + [(None, "w3 w9 copy"), (2000, None), (2001, ""), (2002, "...")]
    items = invented(2, 25) + [(90, "copy copies"), (91, None), (92, "nothing-like-it"), (93, "W3"), (93, "w9 copy"), (94, "the same"), (94, "the same"), (None, "w5 日本")]
    assert found(spark, tmp_path, docs, items, build) == plain(docs, items)


def test_passes_and_k(spark, tmp_path):
    docs, items = invented(3, 200), invented(4, 30)
    assert found(spark, tmp_path, docs, items, {"block_docs": 16}, k=3, pass_items=7, pass_cells=150) == plain(docs, items, 3)


def test_empty_tables(spark, tmp_path):
    assert found(spark, tmp_path, [], [(1, "word")]) == set()
    assert found(spark, tmp_path / "b", [(1, None)], [(1, "word")]) == set()
    assert found(spark, tmp_path / "c", [(1, "word")], []) == set()


def test_repeated_ids_have_ranks_of_their_own(spark, tmp_path):
    docs, items = [(5, "word"), (5, "word"), (6, "other thing")], [(1, "word")]
    got = found(spark, tmp_path, docs, items)
    assert got == plain(docs, items) and sorted(r[1:3] for r in got) == [(1, 5), (2, 5)]


@pytest.mark.parametrize("text", ["a " * 5000 + "Bé" + "x" * 3000 + " a", "y" * 9000, " " * 9000, "Ünder-" * 2000])
def test_long_texts_in_pieces(text):
    ids, texts = pa.array([1], pa.int64()), pa.array([text])
    whole, cut = lexical.postings(ids, texts), lexical.postings(ids, texts, most_bytes=1000)
    count = lambda b: dict(zip(b["terms"].to_pylist(), np.frombuffer(b["tfs"], "<i4").tolist(), strict=True))
    assert count(whole) == count(cut) == Counter(terms(text)) and whole["lengths"][0] == cut["lengths"][0] == len(terms(text))


@pytest.mark.parametrize("build", [None, {"block_docs": 7}])
def test_terms_scored_a_few_at_a_time(spark, tmp_path, build, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_CELLS", 50)
    docs, items = invented(5, 150), invented(6, 20)
    path = str(tmp_path / "index")
    lexical.build_index(spark.createDataFrame(docs, DOCS).coalesce(1), path, **(build or {}))
    index = spark.read.schema(lexical.INDEX).parquet(path)
    n_docs, n_terms = lexical.sums(index)
    rows = [tuple(r) for r in lexical.weigh(spark.createDataFrame(items, ITEMS), index, n_docs, "item_id", "text").orderBy("item_id", "term").collect()]
    query = lexical.Query(rows, 10, n_docs, n_terms)
    hits = pa.Table.from_batches(query.hits(index.toArrow().to_batches())).to_pylist()
    assert {(query.items[h["item"]], h["doc_id"], h["score"]) for h in hits} >= {(i, d, s) for i, _, d, s in plain(docs, items)}


def test_a_row_group_holds_a_block(spark, tmp_path):
    """The reader holds a row group at once; so its memory stays that of a block, however many blocks a file has."""
    path = tmp_path / "index"
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(500)), lambda i: F.hex(F.xxhash64("id", i)))).alias("text"))
    lexical.build_index(docs, str(path), block_docs=10)
    groups = [m.row_group(i) for f in path.glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 40 and max(g.total_byte_size for g in groups) < 40 * 10 * 500


def test_bytes_bound_shares_from_above():
    tfs, norms = np.repeat(np.arange(1, 400), 50), np.tile(np.arange(10, 5010, 100), 399)
    parts = lexical._parts(tfs, norms)
    rounded = -(-parts // lexical.STEP)
    assert rounded.max() <= 255 and (rounded * lexical.STEP >= parts).all() and ((rounded * lexical.STEP - parts) < lexical.STEP).all()
