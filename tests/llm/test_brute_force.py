"""Scores of the language and quality models against plain Python over the same models, and items of few words."""

from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import decontam, langid, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")


def plain_language(model, text):
    """Word by word, each gram hashed for itself."""
    if not text or not any(c.isalpha() for c in text):
        return langid.UNDETERMINED, 0.0
    key_of = {int(k): i for i, k in enumerate(model.word_keys)}
    grams_of = [{int(k): i for i, k in enumerate(keys)} for keys in model.keys]
    sums, n = np.zeros(len(model.languages)), 0
    for token in text.split():
        for word in langid.LETTERS.findall(token.lower()):
            n += 1
            if (at := key_of.get(int(langid.word_keys([word])[0]))) is not None:
                sums += model.word_logs[at]
                continue
            for size in range(langid.LONGEST, 0, -1):
                found = [grams_of[size - 1][k] for k in langid.grams([word], size)[1].tolist() if k in grams_of[size - 1]]
                if found:
                    sums += model.gram_logs[size - 1][found].mean(axis=0)
                    break
    logs = sums / max(n, 1) * min(max(n, 1), langid.TRUST)
    share = np.exp(logs - logs.max())
    return model.languages[int(logs.argmax())], float(1 / share.sum())


def test_language_scores_against_plain_python(spark, docs):
    model = langid.train(docs.where(~langid.held_out()), per_language=40)
    some = docs.where("doc_id % 7 = 0 and length(text) < 3000")
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in langid.identify(some, model).collect()}
    assert len(got) > 10
    for r in some.collect():
        lang, score = plain_language(model, r["text"])
        assert got[r["doc_id"]][0] == lang and abs(got[r["doc_id"]][1] - score) < 1e-4


def test_every_word_of_the_sample_is_known(spark):
    words = [f"{a}{b}{c}{d}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzabcd" for d in "efghijklmnopqrstuvwxyz"[:20]]
    rows = [(i, " ".join(words[i * 400 : (i + 1) * 400]), "xx") for i in range(50)] + [(90, "other words", "yy")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.word_keys) == len(set(words)) + 2


def plain_features(token):
    data = b"<" + token.encode() + b">"
    return [data] + [data[i : i + n] for n in range(quality.SHORTEST, quality.LONGEST + 1) for i in range(len(data) - n + 1)]


def test_quality_scores_against_plain_python(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels.where(~quality.held_out()), most=60)
    some = docs.where("doc_id % 9 = 0 and length(text) < 3000")
    got = {r["doc_id"]: r["quality_score"] for r in quality.score_quality(some, model).collect()}
    assert len(got) > 10
    for r in some.collect():
        total, n = np.zeros(2), 0
        for token, times in Counter((r["text"] or "").split()).items():
            ids = np.concatenate([i for _, i in quality.features([token])])
            assert len(ids) == len(plain_features(token))
            total, n = total + times * model.pushes[ids].sum(axis=0), n + times * len(ids)
        z = total / max(n, 1) + model.bias
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(z[0] - z[1]))) < 1e-4


def test_items_of_one_or_two_words_are_found_whole(spark):
    docs = spark.createDataFrame([(1, "we met Xylo Quartz today"), (2, "quartz and xylo"), (3, "a Zygote."), (4, None), (5, "")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "xylo quartz!"), (11, "zygote"), (12, "..."), (13, None)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["score"]) for r in decontam.leak_pairs(docs, items).collect()} == {(1, 10, 1.0), (3, 11, 1.0)}
    assert [r["doc_id"] for r in decontam.drop_leaks(docs, items).orderBy("doc_id").collect()] == [2, 4, 5]
