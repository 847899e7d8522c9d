"""Language identification: known words by log frequency, unseen words by ever shorter character n-grams."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of, remembered, slices, with_columns, words_of, written

LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
#: Longest n-gram, weight of an unseen count, words that a verdict's score rests on, tokens a worker remembers.
LONGEST, SMOOTH, TRUST, REMEMBERED = 5, 0.1, 10.0, 150_000
#: Characters of unseen words whose n-grams are worked out at once.
PIECE = 1 << 20
#: Factor of the 64-bit hash of n-grams.
FACTOR = 0x9E3779B97F4A7C15


def grams(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word of each n-gram, its 64-bit hash) of the words with a space at both ends."""
    return _grams([f" {w} " for w in words], n)


def _pieces(words: list[str], n: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(word of each piece, pieces) of the words with a space at both ends, of about PIECE characters at a time; a longer word is cut so that each n-gram lies in one piece."""
    owners: list[int] = []
    texts: list[str] = []
    held = 0
    for i, w in enumerate(words):
        for at in range(0, max(len(w) + 3 - n, 1), PIECE):
            # Places count the space before the word.
            piece = w[max(at - 1, 0) : at + PIECE + n - 2]
            piece = (" " if at == 0 else "") + piece + (" " if at + PIECE + n - 2 > len(w) else "")
            owners.append(i)
            texts.append(piece)
            held += len(piece)
            if held >= PIECE:
                yield np.array(owners), texts
                owners, texts, held = [], [], 0
    if texts:
        yield np.array(owners), texts


def _grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    words, sizes = texts, np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    each = np.maximum(sizes - n + 1, 0)
    owner = np.repeat(np.arange(len(words)), each)
    at = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(each) - each), each) + np.arange(len(owner))
    key = np.full(len(at), n, np.uint64)
    for k in range(n):
        key = (key ^ codes[at + k]) * np.uint64(FACTOR)
        key ^= key >> np.uint64(29)
    return owner, key


def word_keys(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each whole word."""
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


class LanguageModel:
    """Log frequencies of words and of character n-grams, both by hash, one value per language."""

    def __init__(self, counts: pa.Table | list[tuple[str, str, int]]):
        """counts: language, word and how often it occurs."""
        if isinstance(counts, list):
            counts = pa.table([pa.array(c, t) for c, t in zip(zip(*counts, strict=True) if counts else ([], [], []), (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "word", "count"])
        self.uid = uuid.uuid4().hex
        langs, names = (counts.column(c).combine_chunks().dictionary_encode() for c in ("lang", "word"))
        self.languages = sorted(langs.dictionary.to_pylist())
        of = {lang: i for i, lang in enumerate(self.languages)}
        place = np.array([of[lang] for lang in langs.dictionary.to_pylist()], np.int64)
        words = names.dictionary.to_pylist()
        table = np.zeros((len(words), len(of)))
        np.add.at(table, (names.indices.to_numpy(zero_copy_only=False), place[langs.indices.to_numpy(zero_copy_only=False)]), counts.column("count").to_numpy())
        keys = word_keys(words)
        order = np.argsort(keys)
        self.word_keys, self.word_logs = keys[order], self._logs(table)[order]
        self.keys, self.gram_logs = [], []
        for n in range(1, LONGEST + 1):
            owner, key = grams(words, n)
            if n == 1:  # the spaces at the ends say nothing
                space = grams([""], 1)[1][0]
                owner, key = owner[key != space], key[key != space]
            keys, at = np.unique(key, return_inverse=True)
            self.keys.append(keys)
            self.gram_logs.append(self._logs(np.column_stack([np.bincount(at, table[owner, k], len(keys)) for k in range(len(of))]) if len(of) else np.zeros((len(keys), 0))))

    @staticmethod
    def _logs(table: np.ndarray) -> np.ndarray:
        return np.log((table + SMOOTH) / (table.sum(axis=0) + SMOOTH * max(len(table), 1))).astype(np.float32)

    def score_words(self, words: list[str]) -> np.ndarray:
        """Logs of each word; of an unseen word the mean over its n-grams of the greatest length of which one is known; else zeros."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        left = np.arange(len(words))
        if len(self.word_keys) and words:
            key = word_keys(words)
            at = np.minimum(np.searchsorted(self.word_keys, key), len(self.word_keys) - 1)
            known = self.word_keys[at] == key
            out[known] = self.word_logs[at[known]]
            left = np.flatnonzero(~known)
        for n in range(LONGEST, 0, -1):
            keys, logs = self.keys[n - 1], self.gram_logs[n - 1]
            if not len(left) or not len(keys):
                continue
            n_hits, sums = np.zeros(len(left), np.int64), np.zeros((len(self.languages), len(left)))
            for owners, texts in _pieces([words[i] for i in left.tolist()], n):
                owner, key = _grams(texts, n)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                owner, at = owners[owner[hit]], at[hit]
                n_hits += np.bincount(owner, minlength=len(left))
                for k in range(len(self.languages)):
                    sums[k] += np.bincount(owner, logs[at, k], len(left))
            some = n_hits > 0
            for k in range(len(self.languages)):
                out[left[some], k] = sums[k][some] / n_hits[some]
            left = left[~some]
        return out

    def word(self, word: str) -> np.ndarray:
        return self.score_words([word])[0]

    def score_tokens(self, tokens: list[str]) -> np.ndarray:
        """For each token the sum of the logs of its words, the number of its words, and 1 if it has a letter."""
        found = [LETTERS.findall(t.lower()) for t in tokens]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        logs = self.score_words([w for x in found for w in x])
        owner = np.repeat(np.arange(len(tokens)), sizes)
        out = np.empty((len(tokens), len(self.languages) + 2), np.float32)
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owner, logs[:, k], len(tokens))
        out[:, -2] = sizes
        out[:, -1] = [any(map(str.isalpha, t)) for t in tokens]
        return out


class Remembered:
    """Rows of tokens that a worker has seen, in one matrix; forgotten all at once when it is full."""

    def __init__(self, width: int, most: int = REMEMBERED):
        self.rows: dict[str, int] = {}
        self.table, self.most = np.empty((most, width), np.float32), most

    def of(self, tokens: list[str], score) -> np.ndarray:
        at = np.fromiter((self.rows.get(t, -1) for t in tokens), np.int64, len(tokens))
        out = np.empty((len(tokens), self.table.shape[1]), np.float32)
        out[at >= 0] = self.table[at[at >= 0]]
        new = np.flatnonzero(at < 0)
        for start in range(0, len(new), 20_000):
            part = new[start : start + 20_000]
            names = [tokens[i] for i in part.tolist()]
            out[part] = score(names)
            for i, t in zip(part.tolist(), names, strict=True):
                if len(t) <= 40:
                    if len(self.rows) >= self.most:
                        self.rows.clear()
                    self.rows[t] = n = len(self.rows)
                    self.table[n] = out[i]
        return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 1000) -> LanguageModel:
    """Fit on a sample of labelled rows: by hash about ``per_language`` documents of each language (all, if it has fewer).

    The words of the sample are counted in Spark, and the counts, which its rows bound, come to the driver: every word
    of every sampled document. Rows with a null text or language are left out.
    """
    labelled = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = written(labelled.groupBy("lang").count(), "languages")  # its size is known when the join is planned
    chance = F.shiftrightunsigned(F.xxhash64("id"), 11) / float(1 << 53)
    sample = labelled.join(sizes, "lang").where(chance < F.lit(per_language) / F.col("count"))
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("word"))
    return LanguageModel(words.groupBy("lang", "word").count().toArrow())


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with ``lang_pred`` and ``lang_score`` (0 to 1) from the whole text.

    Null texts, and texts without a letter, are "und" with score 0, as is everything under a model without languages.
    Ties go to the language that is first by name. Repeated rows get equal results; empty table: empty result. Input
    columns named like an output column are replaced; others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return _predict(shared.value, texts)

    marked = docs.withColumn("__lang", predict.asNondeterministic()(text_col))
    return with_columns(marked, {"lang_pred": F.col("__lang.lang"), "lang_score": F.col("__lang.score")}).drop("__lang")


def _predict(model: LanguageModel, texts: pd.Series) -> pd.DataFrame:
    column = pa.array(texts, pa.string(), from_pandas=True)
    n = len(model.languages)
    seen = remembered(("language", model.uid), lambda: Remembered(n + 2))
    sums = np.zeros((len(column), n + 2))
    for start, size in slices(column, 4 << 20):
        rows, codes, tokens = words_of(column.slice(start, size))
        table = seen.of(tokens, model.score_tokens)
        for k in range(n + 2):
            sums[start : start + size, k] = np.bincount(rows, weights=table[codes, k], minlength=size)
    words = np.maximum(sums[:, n], 1.0)
    logs = sums[:, :n] / words[:, None] * np.minimum(words, TRUST)[:, None]
    if n:
        best = logs.argmax(axis=1)
        score = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
    sure = (sums[:, n + 1] > 0) & (n > 0)
    return pd.DataFrame({"lang": [model.languages[best[i]] if ok else UNDETERMINED for i, ok in enumerate(sure)], "score": [float(score[i]) if ok else 0.0 for i, ok in enumerate(sure)]})


def held_out(id_col: str = "doc_id"):
    """Rows that training leaves out: remainder 2 of the id's crc32 by 4."""
    return crc32_of(id_col) % 4 == 2


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents with a language and a score of at least ``least``, with the columns of docs."""
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), F.col(text_col).alias("__text"))
    kept = identify(row, model, "__text").where((F.col("lang_pred") != UNDETERMINED) & (F.col("lang_score") >= least))
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])

