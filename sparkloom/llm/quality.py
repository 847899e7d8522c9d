"""Quality classifier: hashed word and character n-gram vectors, averaged per document, under a softmax."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of, remembered, slices, with_columns, words_of
from .langid import Remembered

#: Buckets of the hash (a power of two), length of the vectors, shortest and longest n-gram (bytes), passes, documents in a step, rate, bytes of tokens hashed at once.
BUCKETS, WIDTH, SHORTEST, LONGEST, EPOCHS, BATCH, RATE, PIECE = 1 << 16, 10, 3, 5, 12, 32, 0.5, 1 << 18


def features(tokens: list[str], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (token, bucket) of each token and of all its n-grams of bytes, with marks at both ends.

    Blocks hold whole tokens; one longer than PIECE is hashed in pieces, each n-gram in the piece where it starts.
    """
    marked = [b"<" + t.encode("utf-8", "surrogatepass") + b">" for t in tokens]
    start = 0
    while start < len(marked):
        end, held = start + 1, len(marked[start])
        while end < len(marked) and held + len(marked[end]) <= PIECE:
            held += len(marked[end])
            end += 1
        part = marked[start:end]
        yield np.arange(start, end), np.fromiter(map(crc32, part), np.int64, len(part)) & (buckets - 1)
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        data = np.frombuffer(b"".join(part), np.uint8)
        for lo in range(0, held, PIECE):  # more than once only for a token by itself
            owner = np.repeat(np.arange(len(part)), np.minimum(sizes - lo, PIECE))
            room = np.cumsum(sizes)[owner] - np.arange(lo, lo + len(owner))  # bytes from here to the token's end
            codes = data[lo : lo + PIECE + LONGEST - 1].astype(np.uint32)
            for n in range(SHORTEST, LONGEST + 1):
                at = np.flatnonzero(room >= n)
                key = np.full(len(at), n * 2654435761 % (1 << 32), np.uint32)
                for k in range(n):
                    key = (key ^ codes[at + k]) * np.uint32(16777619)
                yield start + owner[at], ((key ^ key >> np.uint32(15)) & np.uint32(buckets - 1)).astype(np.int64)
        start = end


class QualityModel:
    """Vectors of the buckets and softmax weights; what a token adds to the document's two logits is its vectors' sum times the weights."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.vectors, self.weights, self.bias = vectors, weights, bias
        self.pushes, self.uid = vectors @ weights, uuid.uuid4().hex

    def score_tokens(self, tokens: list[str]) -> np.ndarray:
        """Both logits' sums and the number of features of each token."""
        sums = np.zeros((len(tokens), 3))
        for owner, ids in features(tokens, len(self.vectors)):
            lo, hi = owner[0] if len(owner) else 0, owner[-1] + 1 if len(owner) else 0
            for k in range(2):
                sums[lo:hi, k] += np.bincount(owner - lo, self.pushes[ids, k], hi - lo)
            sums[lo:hi, 2] += np.bincount(owner - lo, minlength=hi - lo)
        return sums

    def score(self, logits: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probability of label 1; without features the bias decides."""
        z = logits / np.maximum(counts, 1.0)[:, None] + self.bias
        return 1.0 / (1.0 + np.exp(np.clip(z[:, 0] - z[:, 1], -50, 50)))


def fit(texts: list[str | None], labels: list[int], seed: int = 7, epochs: int = EPOCHS) -> QualityModel:
    """Stochastic gradient descent in numpy over documents given as counts of their features."""
    rng = np.random.default_rng(seed)
    docs = []
    for text in texts:
        _, codes, tokens = words_of(pa.array([text], pa.string()), wide=True)
        if tokens:
            times = np.bincount(codes, minlength=len(tokens))
            n = np.zeros(BUCKETS)
            for owner, ids in features(tokens):
                few, of = np.unique(ids, return_inverse=True)
                n[few] += np.bincount(of, times[owner], len(few))
            buckets = np.flatnonzero(n)
            docs.append((buckets, n[buckets] / n.sum()))
        else:
            docs.append((np.empty(0, np.int64), np.empty(0)))
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    weights, bias = np.zeros((WIDTH, 2)), np.zeros(2)
    target = np.eye(2)[np.array(labels, int)] if labels else np.zeros((0, 2))
    steps, done = epochs * -(-len(docs) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            rate, done = RATE * (1 - done / max(steps, 1)) + 0.01, done + 1
            ids = np.concatenate([docs[i][0] for i in part])
            share = np.concatenate([docs[i][1] for i in part])
            row = np.repeat(np.arange(len(part)), [len(docs[i][0]) for i in part])
            taken = vectors[ids] * share[:, None]
            mean = np.column_stack([np.bincount(row, taken[:, k], len(part)) for k in range(WIDTH)])
            z = mean @ weights + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            off = p / p.sum(axis=1, keepdims=True) - target[part]
            back = off @ weights.T
            weights -= rate * mean.T @ off
            bias -= rate * 0.1 * off.mean(axis=0)
            if len(ids):
                uniq, where = np.unique(ids, return_inverse=True)
                push = back[row] * share[:, None]
                vectors[uniq] -= rate * 10 * np.column_stack([np.bincount(where, push[:, k], len(uniq)) for k in range(WIDTH)])
    return QualityModel(vectors.astype(np.float32), weights.astype(np.float32), bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 5000) -> QualityModel:
    """Fit on at most about ``most`` labelled rows, drawn by a hash of the id; the sample comes to the driver.

    Rows with a null label or id are left out; a null text is empty. Without labelled rows the score is 0.5.
    """
    marked = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    total = marked.count()
    chance = F.shiftrightunsigned(F.xxhash64("id"), 11) / float(1 << 53)
    sample = marked.where(chance < F.lit(most / max(total, 1))).dropDuplicates(["id"])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, "id").orderBy("id", "text").collect()
    return fit([r["text"] for r in rows], [r["label"] for r in rows])


def _score(model: QualityModel, texts: pd.Series) -> np.ndarray:
    column = pa.array(texts, pa.string(), from_pandas=True)
    seen = remembered(("quality", model.uid), lambda: Remembered(3))
    sums = np.zeros((len(column), 3))
    for start, size in slices(column, 4 << 20):
        rows, codes, tokens = words_of(column.slice(start, size), wide=True)
        table = seen.of(tokens, model.score_tokens)
        for k in range(3):
            sums[start : start + size, k] = np.bincount(rows, weights=table[codes, k], minlength=size)
    return model.score(sums[:, :2], sums[:, 2])


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """docs with ``quality_score``, 0 to 1, higher where label 1 is likelier, from the whole text.

    Null and empty texts get the score of the bias alone. Repeated rows get equal scores; empty table: empty result.
    An input column named quality_score is replaced; others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(_score(shared.value, texts))

    return with_columns(docs.withColumn("__score", scored.asNondeterministic()(text_col)), {"quality_score": F.col("__score")}).drop("__score")


def held_out(id_col: str = "doc_id"):
    """Rows that training leaves out: remainder 0 of the id's crc32 by 5."""
    return crc32_of(id_col) % 5 == 0
