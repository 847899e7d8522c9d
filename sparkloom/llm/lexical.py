"""Ranked lexical search over a two-level index: upward-rounded byte impacts bound scores, exact integers decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, shared_path, slices

#: A term is a run of ASCII letters and digits and of characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A byte of an impact stands for so many millionths of a term's weight; 255 of them reach the largest impact.
STEP = 3922
#: Documents and bytes of text in a block; items, and cells of the matrix of items and terms, in a pass over the index.
BLOCK_DOCS, BLOCK_BYTES, PASS_ITEMS, PASS_CELLS = 1024, 8 << 20, 256, 4_000_000
#: Cells of a block's terms and documents that are scored at once.
BLOCK_CELLS = 1 << 20
#: Parquet's reader holds the rows of a row group at once, up to 4096, and its writer looks at their size every 100 rows only.
ROW_GROUPS = {"parquet.block.row.count.limit": "1"}

POSTINGS = "doc_ids array<long>, lengths array<long>, terms array<string>, counts array<int>, docs binary, tfs binary"
INDEX = f"{POSTINGS}, impacts binary"
_ARROW = [("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("docs", pa.binary()), ("tfs", pa.binary())]
HITS = "item int, doc_id long, score long"

#: Bytes in lower case, and a space for each that parts terms.
_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def _plain(texts: pa.Array) -> pa.StringArray:
    """Texts with terms in lower case and spaces between them; null becomes empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(_BYTES[data]))


def _counted(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, term, times) of each term of each row, and the terms."""
    lists = pc.ascii_split_whitespace(texts)
    rows = np.repeat(np.arange(len(texts), dtype=np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not there.all():
        rows, flat = rows[there], flat.filter(pa.array(there))
    coded = flat.dictionary_encode()
    n = max(len(coded.dictionary), 1)
    keys, times = np.unique(rows * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return keys // n, keys % n, times, coded.dictionary


def _pieces(text: pa.StringArray, most_bytes: int) -> Iterator[pa.StringArray]:
    """One long text, in lower case, cut where terms end; a term longer than a piece stays whole."""
    data = text.buffers()[2]
    plain, at = np.frombuffer(data, np.uint8), 0
    while at < len(plain):
        stop = min(at + most_bytes, len(plain))
        while stop < len(plain) and len(ends := np.flatnonzero(plain[stop : stop + most_bytes] == 32)) == 0:
            stop = min(stop + most_bytes, len(plain))
        stop = stop + int(ends[0]) if stop < len(plain) else stop
        yield pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, stop - at], np.int32)), pa.py_buffer(plain[at:stop]))
        at = stop


def postings(ids: pa.Array, texts: pa.Array, most_bytes: int = BLOCK_BYTES) -> dict:
    """A block: its documents with their numbers of terms, and for each term its documents and times there, in order."""
    plain = _plain(texts)
    if len(plain) == 1 and plain.nbytes > most_bytes:
        parts = [(t, d) for _, c, t, d in map(_counted, _pieces(plain, most_bytes)) for d in (d.take(pa.array(c)),)]
        merged = pa.table({"term": pa.concat_arrays([d for _, d in parts]), "n": np.concatenate([t for t, _ in parts])}).group_by("term").aggregate([("n", "sum")])
        words = merged["term"].combine_chunks()
        rows, codes, times = np.zeros(len(words), np.int64), np.arange(len(words)), merged["n_sum"].to_numpy()
    else:
        rows, codes, times, words = _counted(plain)
    lengths = np.bincount(rows, weights=times, minlength=len(ids)).astype(np.int64)
    order = np.lexsort((rows, codes))
    return {"doc_ids": ids, "lengths": lengths, "terms": words, "counts": np.bincount(codes, minlength=len(words)).astype(np.int32), "docs": rows[order].astype("<u2").tobytes(), "tfs": times[order].astype("<i4").tobytes()}


def _norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a document's length weighs, m, in hundredths of a percent of an average one's and ten."""
    return 100 - 90 + (90 * lengths * n_docs) // max(n_terms, 1)


def _parts(tfs: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """A term's share of its weight, in millionths."""
    tfs = tfs.astype(np.int64)
    return (1_000_000_000 * tfs) // (1000 * tfs + 8 * norms)


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> None:
    """Write the index of all documents: a row for each block of up to ``block_docs`` documents and about ``block_bytes`` of text.

    The first pass tokenises whole texts and writes the exact level: for each term of a block its documents and their
    counts. Sums over it give the number of documents and terms; the second pass adds the first level, a byte for each
    posting, its impact by these sums, rounded upwards. No text and no posting is shuffled. A block is a row group of its
    own, so a task that reads the index holds a block or two at a time, however large its file is.

    Nulls: a null text has no terms, a null id is kept. Repeated rows are documents of their own. A text longer than a
    block is counted in pieces cut between terms. Empty table: empty index. Other columns are not read.
    """
    spark = docs.sparkSession
    if not 0 < block_docs <= 1 << 16:
        raise ValueError("a block has 1 to 65536 documents")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, block_docs):
                some = batch.slice(lo, block_docs)
                for first, n in slices(some.column(1), block_bytes):
                    made = postings(some.column(0).slice(first, n), some.column(1).slice(first, n), block_bytes)
                    yield pa.RecordBatch.from_arrays([pa.array([made[k]], kind) for k, kind in _ARROW], schema=pa.schema(_ARROW))

    exact = shared_path(spark, "postings")
    docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(blocks, POSTINGS).write.options(**ROW_GROUPS).parquet(exact)
    blocks_of = spark.read.schema(POSTINGS).parquet(exact)
    n_docs, n_terms = sums(blocks_of)

    def impacts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                norms = _norms(row.column(1)[0].values.to_numpy(), n_docs, n_terms)
                found = _parts(np.frombuffer(row.column(5)[0].as_py(), "<i4"), norms[np.frombuffer(row.column(4)[0].as_py(), "<u2")])
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([(-(-found // STEP)).astype(np.uint8).tobytes()], pa.binary())], names=[*row.schema.names, "impacts"])

    blocks_of.mapInArrow(impacts, INDEX).write.options(**ROW_GROUPS).parquet(path)


def sums(blocks: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and terms of all documents."""
    per = blocks.select(F.size(F.filter("lengths", lambda n: n > 0)).alias("docs"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b).alias("terms"))
    return tuple(per.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first())


def terms_column(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(f"({TERM})"), F.lit(1))


def weigh(items: DataFrame, index: DataFrame, n_docs: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term, weight): the distinct terms of each item that some document holds. Frequencies are summed over all blocks."""
    asked = items.select(F.col(id_col).cast("long").alias("item_id"), F.explode(terms_column(F.col(text_col))).alias("term")).distinct()
    held = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.counts").alias("n"))
    df = held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1)))
    return asked.join(df, "term").select("item_id", "term", weight.cast("long").alias("weight"))


class Query:
    """Items of one pass as a matrix of weights over their terms; goes to the tasks as three arrays."""

    def __init__(self, rows: list[tuple], k: int, n_docs: int, n_terms: int):
        self.items = list(dict.fromkeys(r[0] for r in rows))
        self.terms = list(dict.fromkeys(r[1] for r in rows))
        item, term = {x: i for i, x in enumerate(self.items)}, {x: i for i, x in enumerate(self.terms)}
        self.cells = np.array([(item[a], term[b], w) for a, b, w in rows], np.int64).T
        self.k, self.n_docs, self.n_terms = k, n_docs, n_terms

    def weights(self) -> np.ndarray:
        out = np.zeros((len(self.items), len(self.terms)))
        out[self.cells[0], self.cells[1]] = self.cells[2]
        if out.sum(axis=1).max(initial=0) * 1e6 >= 2**53:
            raise OverflowError("an item's score could pass what doubles hold exactly; split the item")
        return out

    def hits(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best documents of each item in a task's blocks: bounds by bytes first, then exact scores of all that can reach the kth."""
        weights, terms = self.weights(), pa.array(self.terms, pa.string())
        best = [[] for _ in self.items]  # of (-score, the id is null, id), sorted
        least = np.zeros(len(self.items))  # the kth lower bound so far
        for batch in batches:
            for b in range(batch.num_rows):
                self._block({n: batch.column(i)[b] for i, n in enumerate(batch.schema.names)}, weights, terms, best, least)
        rows = [(i, d, -s) for i, found in enumerate(best) for s, _, d in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "doc_id", "score"])

    def _block(self, block: dict, weights: np.ndarray, terms: pa.Array, best: list, least: np.ndarray) -> None:
        at = pc.index_in(block["terms"].values, value_set=terms)
        asked = np.flatnonzero(pc.is_valid(at).to_numpy(zero_copy_only=False))
        if not len(asked):
            return
        weights = weights[:, at.take(pa.array(asked)).to_numpy()]
        counts = block["counts"].values.to_numpy().astype(np.int64)
        starts, some = np.cumsum(counts) - counts, counts[asked]
        # The places of the asked terms' postings, term by term.
        places = np.arange(some.sum()) + np.repeat(starts[asked] - (np.cumsum(some) - some), some)
        row, docs = np.repeat(np.arange(len(asked)), some), np.frombuffer(block["docs"].as_py(), "<u2")[places]
        lengths = block["lengths"].values.to_numpy()
        impacts = np.frombuffer(block["impacts"].as_py(), np.uint8)[places]
        step = max(1, BLOCK_CELLS // len(lengths))

        def pieces(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """A few terms at a time: the items' weights for them, and their values by document."""
            for lo in range(0, len(asked), step):
                a, b = np.searchsorted(row, (lo, lo + step))
                cells = np.zeros((min(step, len(asked) - lo), len(lengths)), np.int64)
                cells[row[a:b] - lo, docs[a:b]] = values[a:b]
                yield weights[:, lo : lo + step], cells

        upper, lower = np.zeros((2, len(weights), len(lengths)))
        for w, cells in pieces(impacts):
            upper += w @ (cells * float(STEP))
            lower -= w @ ((cells > 0) * (STEP - 1.0))
        lower += upper
        if lower.shape[1] > self.k:
            here = np.partition(lower, -self.k, axis=1)[:, -self.k :]
        else:
            here = np.pad(lower, ((0, 0), (self.k - lower.shape[1], 0)))
        known = np.array([[0.0] * (self.k - len(f)) + [-s for s, _, _ in f] for f in best])
        np.maximum(least, np.sort(np.concatenate([here, known], axis=1), axis=1)[:, -self.k], out=least)
        items, found = np.nonzero((upper >= least[:, None]) & (upper > 0))
        if not len(items):
            return
        columns, of = np.unique(found, return_inverse=True)
        norms, scores = _norms(lengths[columns], self.n_docs, self.n_terms), np.zeros((len(weights), len(columns)))
        for w, cells in pieces(np.frombuffer(block["tfs"].as_py(), "<i4")[places]):
            scores += w @ _parts(cells[:, columns], norms)
        scores = scores.astype(np.int64)[items, of]
        ids = block["doc_ids"].values.take(pa.array(columns)).to_pylist()
        bounds = np.searchsorted(items, np.arange(len(best) + 1))
        for i in np.unique(items):
            lo, hi = bounds[i], bounds[i + 1]
            near = np.arange(lo, hi)
            if len(near) > self.k:  # ties of the kth stay
                near = near[scores[lo:hi] >= np.partition(scores[lo:hi], -self.k)[-self.k]]
            fresh = ((-int(scores[p]), ids[of[p]] is None, ids[of[p]]) for p in near if scores[p] > 0)
            best[i] = sorted([*best[i], *fresh], key=lambda x: (x[0], x[1], x[2] or 0))[: self.k]


def _passes(weighed: DataFrame, most_items: int, most_cells: int) -> Iterator[list[tuple]]:
    """Items in turn, as many as fit into one pass, streamed to the driver pass by pass."""
    rows, items, terms = [], 0, set()
    for r in weighed.orderBy("item_id", "term").toLocalIterator():
        if not rows or r[0] != rows[-1][0]:
            if rows and (items >= most_items or (items + 1) * len(terms) > most_cells):
                yield rows
                rows, items, terms = [], 0, set()
            items += 1
        rows.append(tuple(r))
        terms.add(r[1])
    if rows:
        yield rows


def search(spark: SparkSession, path: str, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", pass_items: int = PASS_ITEMS, pass_cells: int = PASS_CELLS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, by falling score, then rising doc_id.

    Items go over the index in passes of up to ``pass_items``, each one scan without a shuffle of the index. In a block
    byte impacts bound the scores of all its documents from above and below; every document whose upper bound reaches the
    kth lower bound of the task so far is scored again in exact integers, ties included. A task gives out at most k
    documents an item, and a window over these, limited before its shuffle, ranks them.

    Nulls: an item with a null text or no term has no rows; rows with the same item_id are one item with the terms of
    all; a null doc_id comes last among equal scores. Documents that share a doc_id each have a rank of their own.
    Empty tables: empty result.
    """
    index = spark.read.schema(INDEX).parquet(path)
    n_docs, n_terms = sums(index)
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for rows in _passes(weigh(items, index, n_docs, id_col, text_col), pass_items, pass_cells):
        query = Query(rows, k, n_docs, n_terms)
        names = spark.createDataFrame(list(enumerate(query.items)), "item int, item_id long")
        found = found.unionByName(index.mapInArrow(query.hits, HITS).join(F.broadcast(names), "item").select("item_id", "doc_id", "score"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
