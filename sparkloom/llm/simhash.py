"""SimHash near-duplicates: fingerprints joined on a grid of segment popcounts, then verified exactly."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, remembered, with_columns, written
from .components import components

#: The 32 two-bit segments fall into six groups of neighbours. Two fingerprints within three bits differ in at most
#: three segments (the Manhattan distance of their popcounts is at most their Hamming distance), so in at most three
#: groups: the popcounts of some three groups are equal.
MAX_BITS, GROUPS = 3, (6, 6, 5, 5, 5, 5)
#: Members up to which a cell of the grid is compared pair by pair.
PAIRWISE = 256


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over word shingles of the whole text, A-Z lower-cased; 0 without words."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    hashes = np.fromiter((xxh64_intdigest(s, seed) for s in shingles), np.uint64, max(1, len(parts) - words + 1))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def add_fingerprint(docs: DataFrame, text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """docs with ``fingerprint``, the 64 bits as a signed long."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        remembered(("simhash",), dict)
        return pd.Series(np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64))

    simhash = simhash.asNondeterministic()
    return with_columns(docs.withColumn("__fp", simhash(text_col)), {"fingerprint": F.col("__fp")}).drop("__fp")


def _masks() -> list[int]:
    """For each choice of three groups the bits of their segments."""
    ends = np.cumsum((0, *GROUPS)) * 2
    each = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(ends, ends[1:], strict=False)]
    return [a | b | c for a, b, c in combinations(each, len(GROUPS) - MAX_BITS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _popcounts(fp: Column) -> Column:
    """The popcount of every two-bit segment, in place."""
    low = F.lit(_signed(0x5555555555555555))
    a, b = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return F.shiftleft(a.bitwiseAND(b), 1).bitwiseOR(a.bitwiseXOR(b))


class _Forest:
    """Smallest member of each class of some values, merged pair by pair in numpy."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                break
            a, b, lo, hi = a[open_], b[open_], np.minimum(ra, rb)[open_], np.maximum(ra, rb)[open_]
            np.minimum.at(root, hi, lo)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def _link_cell(fps: np.ndarray, forest: _Forest, at: np.ndarray) -> None:
    """Link all members of one cell within MAX_BITS. Large cells are cut by equal bits: of six blocks of the
    fingerprint at least three are equal, so every near pair meets in one of 20 cuts."""
    n = len(fps)
    if n <= PAIRWISE:
        i, j = np.triu_indices(n, 1)
        near = np.bitwise_count(fps[i] ^ fps[j]) <= MAX_BITS
        forest.merge(at[i[near]], at[j[near]])
        return
    for mask in _masks():
        kept = fps & np.uint64(mask)
        order = np.argsort(kept, kind="stable")
        edges = np.flatnonzero(np.r_[True, kept[order][1:] != kept[order][:-1], True])
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            for lo in range(s, e, 2048) if e - s > 1 else ():
                mine = order[lo : min(lo + 2048, e)]
                for lo2 in range(lo, e, 2048):
                    other = order[lo2 : min(lo2 + 2048, e)]
                    i, j = np.nonzero(np.bitwise_count(fps[mine][:, None] ^ fps[other][None, :]) <= MAX_BITS)
                    forest.merge(at[mine[i]], at[other[j]])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (choice, cell, fp) sorted by cell become one row (fp, smaller fp of its class) for each linked member."""
    held: list[np.ndarray] = [np.empty((0, 3), np.int64)]

    def flush(rows: np.ndarray) -> pa.RecordBatch | None:
        starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(rows)])
        many = np.repeat(sizes > 1, sizes)
        rows = rows[many]
        if not len(rows):
            return None
        sizes = sizes[sizes > 1]
        starts = np.cumsum(sizes) - sizes
        values, at = np.unique(rows[:, 2], return_inverse=True)
        forest, fps = _Forest(len(values)), rows[:, 2].view(np.uint64)
        small = sizes <= 32
        group = np.repeat(np.arange(len(sizes)), sizes)
        pick = np.flatnonzero(small[group])
        for d in range(1, int(sizes[small].max(initial=1))):
            i, j = pick[:-d], pick[d:]
            i, j = i[same := group[i] == group[j]], j[same]
            near = np.bitwise_count(fps[i] ^ fps[j]) <= MAX_BITS
            forest.merge(at[i[near]], at[j[near]])
        for g in np.flatnonzero(~small):
            part = slice(starts[g], starts[g] + sizes[g])
            _link_cell(np.ascontiguousarray(fps[part]), forest, at[part])
        moved = np.flatnonzero(forest.root != np.arange(len(values)))
        return pa.RecordBatch.from_arrays([pa.array(values[moved]), pa.array(values[forest.root[moved]])], ["u", "v"]) if len(moved) else None

    for batch in batches:
        rows = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
        held.append(rows)
        if sum(map(len, held)) < 200_000:
            continue
        rows = np.concatenate(held)
        last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
        cut = last[-1] + 1 if len(last) else 0  # the last cell may go on
        held = [rows[cut:]]
        if cut and (out := flush(rows[:cut])) is not None:
            yield out
    if (out := flush(np.concatenate(held))) is not None:
        yield out


def near_links(fps: DataFrame, fp_col: str = "fingerprint") -> DataFrame:
    """(u, v): links that connect all distinct fingerprints within three bits.

    Every fingerprint goes to 20 cells, one for each three groups of segments, keyed by their popcounts. Inside a cell
    members are compared by numpy and only a forest of links leaves it, never all pairs.
    """
    distinct = fps.select(F.col(fp_col).alias("fp")).where("fp is not null").distinct()
    masks = F.array(*[F.lit(_signed(m)) for m in _masks()])
    cells = distinct.select("fp", F.posexplode(masks).alias("choice", "mask")).select("choice", _popcounts(F.col("fp")).bitwiseAND(F.col("mask")).alias("cell"), "fp")
    dealt = cells.repartition("choice", "cell").sortWithinPartitions("choice", "cell")
    return dealt.mapInArrow(_linked, "u long, v long")


def near_classes(marked: DataFrame, id_col: str = "doc_id", fp_col: str = "fingerprint") -> DataFrame:
    """marked with ``component_id`` and ``component_print``: the smallest id of the row's class, and the fingerprint of a row with it.

    Exact copies collapse to one fingerprint before the join; classes are found over fingerprints and joined back.
    marked is read twice, so give a written table.
    """
    prints = checkpoint(marked.groupBy(fp_col).agg(F.min(id_col).alias("least")).withColumnRenamed(fp_col, "fp"))
    roots = components(near_links(prints, "fp")).withColumnRenamed("node", "fp")
    classed = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classed.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("c"))
    of = classed.join(least, "root").select(F.col("fp").alias("__print"), F.col("c.least").alias("__id"), F.col("c.fp").alias("__of"))
    joined = marked.join(of, F.col(fp_col) == F.col("__print"))
    return with_columns(joined, {"component_id": F.col("__id"), "component_print": F.col("__of")}).drop("__print", "__id", "__of")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """docs with ``fingerprint`` (signed long), ``component_id``, the smallest id reachable over links of at most three bits, and ``component_print``.

    The fingerprinted rows are written to the shared folder once, with the columns of docs. A null or empty text, or
    one of white space, has fingerprint zero and is linked like any other. A null id is never the smallest unless the
    class has no other; repeated rows share their class. Empty table: empty result. Input columns named like an output
    column are replaced; others pass through.
    """
    return near_classes(written(add_fingerprint(docs, text_col, words, seed), "fingerprints"), id_col)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """One document of each class stays, the one with the smallest id; of rows that repeat its id and fingerprint, one."""
    marked = near_duplicates(docs, id_col, text_col, words, seed)
    first = marked.where(F.col(id_col).eqNullSafe(F.col("component_id")) & (F.col("fingerprint") == F.col("component_print")))
    return first.dropDuplicates([id_col, "fingerprint"]).select(*[f"`{c}`" for c in docs.columns])
