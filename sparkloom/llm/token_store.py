"""Token ids of a corpus in binary frames: tokenised, range-coded, written by Spark and read back."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import range_coder
from .common import remembered, slices, words_of

#: Ids from which on a frame is closed; words and characters of words that a worker remembers; bytes of texts that are tokenised at once.
FRAME_IDS, REMEMBERED, REMEMBERED_BYTES, TEXT_BYTES = 1_200_000, 400_000, 1 << 23, 4 << 20
#: Bytes of texts whose capitals stay: special tokens, and the first bytes of U+0300 to U+037F, combining marks that are or become parts of letters.
AS_IS = (b"<|", b"\xcc", b"\xcd")
#: The parts of a tokenizer's file that allow for tokenising word by word: white space falls out, nothing is joined across it.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}
#: Lines with a character that is not plain. Plain words are their own normal form; their characters beyond ASCII, ß to ÿ, are letters of two bytes.
ODD = re.compile("^.*[^\n!-;=-@\\[-~ß-öø-ÿ].*$", re.M)
#: The tokenizer's pieces of plain words, their bytes written as one character each.
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\uffff]+|[0-9]|\n|[^a-z0-9\n\x80-\uffff]+")
#: Rows of the file format, in Parquet: a frame holds whole documents; part and seq give the frames' order.
FRAMES = "part int, seq int, doc_ids array<long>, counts array<long>, n_ids long, frame binary"
DECODED = "part int, seq int, place int, doc_id long, n_tokens long, before long, ids_crc32 long"


class _WordEncoder:
    """Ids of texts under a tokenizer that drops white space and joins nothing across it, by their words in turn.

    Each distinct word goes through the tokenizers library once, and is remembered for some time. The tokenizer
    lower-cases, so that words that differ by A-Z alone count as one; but for texts that may hold names of its special
    tokens, or combining marks, which it joins to some small letters and not to their capitals. Words of plain letters
    are cut into the tokenizer's pieces here, and the library merges the pieces.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        # The tokenizer's own characters for the bytes of ß, à and í that are not printable; other bytes stand for themselves.
        self.signs = {c.encode()[1:].decode("latin-1"): pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0][1] for c in "ßàí"}
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, int] = {}
        self.ids, self.sizes, self.starts, self.held = np.empty(0, np.uint32), np.empty(0, np.int32), np.empty(0, np.int64), 0

    def _learn(self, words: list[str]) -> np.ndarray:
        """Remember new words; the place of each."""
        odd = set(ODD.findall("\n".join(words)))
        is_plain = np.fromiter((w not in odd for w in words), bool, len(words))
        plain, other = [w for w in words if w not in odd], [w for w in words if w in odd]
        lines = "\n".join([*plain, ""]).encode().decode("latin-1")
        for byte, sign in self.signs.items():
            lines = lines.replace(byte, sign)
        pieces = PIECE.findall(lines)
        index = {"\n": 0} | {p: i for i, p in enumerate((p for p in dict.fromkeys(pieces) if p != "\n"), 1)}
        at = np.fromiter(map(index.__getitem__, pieces), np.int64, len(pieces))
        merge = self.model.tokenize
        ids = np.fromiter((token.id for piece in [*index][1:] for token in merge(piece)), np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1  # every piece has one end
        if len(ends) != len(index) - 1:
            raise ValueError("a piece has no end, or several")
        sizes = np.r_[0, np.diff(ends, prepend=0)]  # the line feed after each word has no ids
        each = np.cumsum(sizes[at])[at == 0]
        encoded = [e.ids for i in range(0, len(other), 20_000) for e in self.whole.encode_batch_fast(other[i : i + 20_000], add_special_tokens=False)]
        flat = np.concatenate([_gathered(ids, np.cumsum(sizes) - sizes, sizes, at), np.fromiter(chain.from_iterable(encoded), np.uint32)])
        sizes = np.r_[np.diff(each, prepend=0), np.fromiter(map(len, encoded), np.int64, len(encoded))]
        first = len(self.known)
        self.known.update(zip([*plain, *other], range(first, first + len(words)), strict=True))
        self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(sizes) - sizes]
        self.sizes = np.r_[self.sizes, sizes.astype(np.int32)]
        self.ids = np.r_[self.ids, flat]
        self.held += sum(map(len, words))
        places = np.empty(len(words), np.int64)
        places[is_plain] = first + np.arange(len(plain))
        places[~is_plain] = first + len(plain) + np.arange(len(other))
        return places

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """texts -> (ids of all texts, number of ids of each)."""
        raw = texts.cast(pa.binary())
        as_is = any(pc.any(pc.match_substring(raw, mark), min_count=0).as_py() for mark in AS_IS)
        rows, codes, words = words_of(texts if as_is else pc.ascii_lower(texts))
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.known) + len(new) > REMEMBERED or self.held > REMEMBERED_BYTES:  # what this batch doesn't use is forgotten
                self._keep(words, at)
            at[new] = self._learn([words[i] for i in new.tolist()])
        at = at[codes]
        return _gathered(self.ids, self.starts, self.sizes, at), np.bincount(rows, weights=self.sizes[at], minlength=len(texts)).astype(np.int64)

    def _keep(self, words: list[str], at: np.ndarray) -> None:
        """Forget all but the known ones of these words, and set their new places."""
        some = np.flatnonzero(at >= 0)
        self.ids, self.sizes = _gathered(self.ids, self.starts, self.sizes, at[some]), self.sizes[at[some]]
        self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        at[some] = np.arange(len(some))
        self.known = {words[i]: n for n, i in enumerate(some.tolist())}
        self.held = sum(map(len, self.known))


def _gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The stretches of ids that start at starts, one after the other in the order of at."""
    each = sizes[at]
    shift = starts[at] - (np.cumsum(each, dtype=np.int64) - each)
    return ids[np.repeat(shift, each) + np.arange(int(each.sum()))]


def _whole_texts(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Ids of texts under any tokenizer: each whole text goes through the library."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    return encode


def _encoder(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """texts -> (ids of all texts, number of ids of each), word by word where the tokenizer's file allows for it."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks have the cores

    def made():
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model = said["model"]
        by_word = all(said.get(k) == v for k, v in BY_WORD.items()) and (model["type"], model.get("end_of_word_suffix"), model.get("dropout")) == ("BPE", "</w>", None)
        return _WordEncoder(path) if by_word else _whole_texts(path)

    return remembered(("tokens", path), made)


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", frame_ids: int = FRAME_IDS) -> None:
    """Write the ids of every whole text, and end_id after each, to ``out`` in ascending id order.

    Documents are dealt by ranges of (id, hash of the text) and sorted, so frames are in order within a part and parts
    among each other; a document is in one frame. Spark commits the files: a task that is lost runs again, with the
    same frames. A worker holds one frame's ids, and the longest document.

    Nulls: a null or empty text has end_id alone; null ids come first. Rows that repeat an id stand one after the other
    by their text; equal rows in any order. Empty table: no frames. Other columns aren't read.
    """

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        counts: list[int] = []
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "doc_ids": doc_ids, "counts": counts, "n_ids": len(ids), "frame": range_coder.encode(ids)}], schema=_schema())

        for batch in batches:
            texts, names = batch.column("text"), batch.column("id").to_pylist()
            for start, size in slices(texts, TEXT_BYTES):
                ids, sizes = encode(texts.slice(start, size))
                ended = np.full(len(ids) + size, end_id, np.uint32)
                ended[np.arange(len(ids)) + np.repeat(np.arange(size), sizes)] = ids
                sizes = sizes + 1
                held.append(ended)
                doc_ids += names[start : start + size]
                counts += sizes.tolist()
                if sum(map(len, held)) >= frame_ids:
                    yield close()
                    seq += 1
                    doc_ids, counts, held = [], [], []
        if held:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", "text")
    dealt.mapInArrow(frames, FRAMES).write.parquet(out)


def _schema() -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("frame", pa.binary())])


def _frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAMES).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids: the ids of each document, from the files. A damaged frame stops the read."""

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = range_coder.decode(row["frame"])
                ends = np.cumsum(row["counts"])
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids, pa.int64()))], ["doc_id", "ids"])

    return _frames(spark, path).mapInArrow(ids_of, "doc_id long, ids array<long>")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from its decoded ids.

    start: ids of all documents before it. Sums of whole parts come first, one row each, then those of the frames inside
    a part; documents add their place in the frame.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered(("frames",), dict)
        for batch in batches:
            for row in batch.to_pylist():
                data = range_coder.decode(row["frame"]).astype("<u4")
                ends = np.cumsum(row["counts"])
                if len(data) != row["n_ids"] or (ends[-1] if len(ends) else 0) != len(data):
                    raise ValueError("a frame doesn't hold the ids of its documents")
                sums = [crc32(data[a:b].tobytes()) for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]
                n = len(sums)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["counts"], pa.int64()), pa.array(ends - np.array(row["counts"]), pa.int64()), pa.array(sums, pa.int64())], ["part", "seq", "place", "doc_id", "n_tokens", "before", "ids_crc32"])

    frames = _frames(spark, path)
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sums = frames.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(parts), F.lit(0)).alias("part_start"))
    starts = frames.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("seq_start")).join(sums, "part")
    decoded = frames.mapInArrow(digests, DECODED)
    return decoded.join(starts, ["part", "seq"]).select("doc_id", (F.col("part_start") + F.col("seq_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
