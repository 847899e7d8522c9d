"""Benchmark decontamination: rare n-gram seeds propose passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remembered, slices, with_columns, words_of

#: Words of a seed; the rarest of so many neighbouring n-grams is a seed; bytes of item text that are held at once.
SEED_WORDS, NEIGHBOURS, BLOCK_BYTES = 3, 2, 8 << 20
#: Alignment: a match adds 1, a mismatch or gap takes COST; least share of the item's length to count as a leak.
COST, LEAK = 0.5, 0.5
LEAKS = "array<struct<item_id:long,score:double>>"


def normal(token: str) -> str:
    """Lower case, without what is neither letter nor digit at the ends."""
    token = token.lower()
    i, j = 0, len(token)
    while i < j and not token[i].isalnum():
        i += 1
    while j > i and not token[j - 1].isalnum():
        j -= 1
    return token[i:j]


class Items:
    """A block of test items: word ids, the n-grams of each, and for each n-gram where it stands."""

    def __init__(self, items: list[tuple[int, str]], n: int = SEED_WORDS):
        self.n, self.vocabulary = n, {}
        self.ids, self.words = [], []
        #: Items of fewer words than a seed has, by their number of words: (item, words).
        self.short: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        rows, codes, tokens = words_of(pa.array([text for _, text in items], pa.string()), wide=True)
        edges, forms = np.searchsorted(rows, np.arange(len(items) + 1)), [normal(t) for t in tokens]
        for (item, _), lo, hi in zip(items, edges[:-1], edges[1:], strict=True):
            words = [w for c in codes[lo:hi].tolist() if (w := forms[c])]
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64)
            if len(words) >= n:
                self.ids.append(item)
                self.words.append(numbers)
            elif words:
                self.short[len(words)].append((item, numbers))
        self.places = defaultdict(list)
        for i, words in enumerate(self.words):
            for at, key in enumerate(self._keys(words)):
                self.places[int(key)].append((i, at))
        self.keys = np.array(sorted(self.places), np.int64)

    def _keys(self, words: np.ndarray, n: int | None = None) -> np.ndarray:
        """One number for each n-gram of words; -1 where a word is not in any item."""
        n = n or self.n
        m = len(words) - n + 1
        if m <= 0:
            return np.empty(0, np.int64)
        parts = [words[k : k + m] for k in range(n)]
        key, bad = np.zeros(m, np.int64), np.zeros(m, bool)
        for p in parts:  # vocabularies of a block stay under 2**21 words, by BLOCK_BYTES
            key = (key << 21) | np.maximum(p, 0)
            bad |= p < 0
        return np.where(bad, -1, key)

    def hits(self, words: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in words where one of the sorted keys stands, and which."""
        if not len(keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        found = self._keys(words)
        at = np.flatnonzero(found >= 0)
        index = np.minimum(np.searchsorted(keys, found[at]), len(keys) - 1)
        same = keys[index] == found[at]
        return at[same], index[same]

    def whole(self, words: np.ndarray) -> list[tuple[int, float]]:
        """The short items whose words stand in a row among these."""
        out = []
        for n, items in self.short.items():
            found = set(self._keys(words, n).tolist())
            out += [(item, 1.0) for item, of in items if int(self._keys(of, n)[0]) in found]
        return out

    def seeds(self, frequency: dict[int, int]) -> np.ndarray:
        """Of any NEIGHBOURS n-grams in a row the one that fewest documents hold."""
        chosen = set()
        for words in self.words:
            keys = self._keys(words)
            often = np.array([frequency.get(int(k), 0) for k in keys])
            for s in range(max(1, len(keys) - NEIGHBOURS + 1)):
                chosen.add(int(keys[s + int(often[s : s + NEIGHBOURS].argmin())]))
        return np.array(sorted(chosen), np.int64)


def _documents(items: Items, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word ids) of the documents; words of no item are -1, tokens without letter or digit are left out."""
    remembered(("leaks",), dict)
    for start, size in slices(column, 4 << 20):
        rows, codes, tokens = words_of(column.slice(start, size), wide=True)
        if not len(codes):
            continue
        known = items.vocabulary
        of = np.array([known.get(w, -1) if (w := normal(t)) else -2 for t in tokens], np.int64)
        ids = of[codes]
        real = ids != -2
        rows, ids = rows[real], ids[real]
        # Only documents with enough known words in a row can hold a seed or a short item.
        least = min([items.n, *items.short])
        run = np.ones(max(0, len(ids) - least + 1), bool)
        for k in range(least):
            run &= ids[k : k + len(run)] >= 0
        edges = np.searchsorted(rows, np.arange(size + 1))
        for r in np.unique(rows[np.flatnonzero(run)]):
            yield start + int(r), ids[edges[r] : edges[r + 1]]


def align(item: np.ndarray, words: np.ndarray, cost: float = COST) -> float:
    """Smith-Waterman score of the best local alignment, by rows of the item; gaps along a row by a running maximum."""
    slope = cost * np.arange(len(words) + 1)
    above, best = np.zeros(len(words) + 1), 0.0
    for w in item:
        row = np.maximum(above - cost, 0.0)
        np.maximum(row[1:], above[:-1] + np.where(words == w, 1.0, -cost), out=row[1:])
        above = np.maximum.accumulate(row + slope) - slope
        best = max(best, float(above.max()))
    return best


def leaks_of(items: Items, seeds: np.ndarray, words: np.ndarray, least: float = LEAK) -> list[tuple[int, float]]:
    """(item, score) of the items that a document holds: seeds on near diagonals open a stretch of text to align."""
    at, which = items.hits(words, seeds)
    diagonals: dict[int, set[int]] = defaultdict(set)
    for p, k in zip(at.tolist(), which.tolist(), strict=True):
        for i, q in items.places[int(seeds[k])]:
            diagonals[i].add(p - q)
    out = items.whole(words)
    for i, found in diagonals.items():
        item, best = items.words[i], 0.0
        pad = len(item) // 2 + 2
        stretch: list[list[int]] = []
        for d in sorted(found):
            if stretch and d - pad <= stretch[-1][1]:
                stretch[-1][1] = d + len(item) + pad
            else:
                stretch.append([d - pad, d + len(item) + pad])
        for lo, hi in stretch:
            best = max(best, align(item, words[max(0, lo) : hi]) / len(item))
            if best >= 1.0:
                break
        if best >= least:
            out.append((items.ids[i], round(best, 6)))
    return sorted(out, key=lambda x: (x[0] is None, x[0]))


def document_frequency(docs: DataFrame, items: Items, text_col: str) -> dict[int, int]:
    """In how many documents each n-gram of the items stands: counted by task, then summed in Spark; one row per n-gram of the block returns."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        n = np.zeros(len(block.keys), np.int64)
        for batch in batches:
            for _, words in _documents(block, batch.column(0)):
                n[np.unique(block.hits(words, block.keys)[1])] += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(block.keys[some]), pa.array(n[some])], ["key", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "key long, n long")
    return {r["key"]: r["n"] for r in counted.groupBy("key").agg(F.sum("n").alias("n")).collect()}


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = LEAK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with ``leaks``: the benchmark items (item_id, score) of which the text holds a copy, exact or edited.

    score is the alignment's share of the item's length, from ``least`` on. Words are compared in lower case without
    signs at their ends; Unicode white space parts them, in documents as in items. Items go in blocks of about ``block_bytes`` of text, each block against all documents: first
    the documents that hold each n-gram of a block are counted, then of any two neighbouring n-grams the rarer is a
    seed, and where a document holds seeds of an item it is aligned with the text around them. Frequency only decides
    between neighbours: a passage that every document repeats still has its seeds.

    Nulls: a null text has no leaks; a null item text, or an item without a letter or digit, is never found; an item
    of one or two words is found where all of them stand in a row. A null item id is reported as null. Repeated rows get equal results. No items or no documents: no leaks. An input column
    named leaks is replaced; others pass through.
    """
    asked = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text")).where("text is not null")
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-total // block_bytes)
    found = F.array().cast(LEAKS)
    marked = docs
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).distinct().orderBy("id", "text").collect()
        items = Items([(r["id"], r["text"]) for r in rows])
        seeds = items.seeds(document_frequency(docs, items, text_col))
        marked = marked.withColumn(f"__leaks{b}", _leaks(docs.sparkSession, items, seeds, least)(text_col))
        found = F.concat(found, F.coalesce(F.col(f"__leaks{b}"), F.array().cast(LEAKS)))
    return with_columns(marked, {"leaks": found}).drop(*[f"__leaks{b}" for b in range(blocks)])


def _leaks(spark, items: Items, seeds: np.ndarray, least: float):
    shared = spark.sparkContext.broadcast((items, seeds))

    @F.pandas_udf(LEAKS)
    def leaks(texts: pd.Series) -> pd.Series:
        block, keys = shared.value
        out: list = [[] for _ in range(len(texts))]
        for row, words in _documents(block, pa.array(texts, pa.string(), from_pandas=True)):
            out[row] = [{"item_id": i, "score": s} for i, s in leaks_of(block, keys, words, least)]
        return pd.Series(out)

    return leaks.asNondeterministic()


def leak_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **params) -> DataFrame:
    """One row (doc_id, item_id, score) for each document and item it holds."""
    found = find_leaks(docs, benchmark, **params).select(F.col(id_col).alias("doc_id"), F.explode("leaks").alias("x"))
    return found.groupBy("doc_id", F.col("x.item_id").alias("item_id")).agg(F.max("x.score").alias("score"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **params) -> DataFrame:
    """The documents that hold no benchmark item, with the columns of docs."""
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), F.col(text_col).alias("__text"))
    return find_leaks(row, benchmark, "__text", **params).where(F.size("leaks") == 0).select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
