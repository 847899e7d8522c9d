"""The columns of the queries that SQL can't express, against plain Python over the same rows; clashing column names."""

import hashlib
from zlib import crc32

import numpy as np
import pytest
from test_operators import brute_base, expected_ids

from sparkloom.llm import decontam, html_extract, langid, pii, quality, queries, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_pii_columns(spark, texts):
    kinds = ("email", "ip", "card", "phone")
    got = by_id(queries.op1_pii(spark, SF))
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        spans = sorted(brute_base(text), key=lambda s: (kinds.index(s[0]), s[1]))
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in spans) for k in kinds]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(got[i]["spans"].split(",")) | {""} and len(got[i]["scores"].split(",")) == len(got[i]["spans"].split(","))


def test_pii_context_words_of_four_languages():
    for text in ("my social security 123-45-6789", "Sozialversicherung 123-45-6789", "sécurité sociale 123-45-6789", "seguridad 123-45-6789"):
        assert [s[0] for s in pii.spans_of(text)] == ["ssn"], text


def test_simhash_columns(spark, texts):
    got = by_id(queries.op5_simhash(spark, SF))
    prints = {i: simhash.fingerprint(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    left = set(prints)
    while left:
        seen, queue = {min(left)}, [min(left)]
        while queue:
            a = queue.pop()
            near = {b for b in left - seen if (prints[a] ^ prints[b]).bit_count() <= 3}
            seen |= near
            queue += near
        assert {got[i]["component_id"] for i in seen} == {min(seen)}
        left -= seen


def test_token_columns(spark, texts):
    got, start = by_id(queries.op6_token_ids(spark, SF)), 0
    for i, ids in zip(sorted(texts), expected_ids(texts[i] for i in sorted(texts)), strict=True):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_language_and_quality_columns(spark, texts):
    lang, qual = by_id(queries.op8_langid(spark, SF)), by_id(queries.op9_quality(spark, SF))
    assert lang.keys() == qual.keys() == texts.keys()
    for i, text in texts.items():
        assert lang[i]["held_out"] == (crc32(str(i).encode()) % 4 == 2) and 0 <= lang[i]["score"] <= 1
        assert (lang[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in text))
        assert qual[i]["held_out"] == (crc32(str(i).encode()) % 5 == 0) and qual[i]["predicted"] == int(qual[i]["score"] >= 0.3)


def test_page_columns(spark):
    rows = queries.op2_html_extract(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count() and all(r["n_chars"] == len(r["text"]) for r in rows)


def test_columns_of_clashing_names_are_replaced_and_others_pass(spark):
    rows = [(1, "call +1 212 555 0100 now", "en", "x", 1, 2, 3, 4, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, Pii string, LANG_PRED int, lang_score int, quality_score int, Leaks int, fingerprint int, component_id int")
    items = spark.createDataFrame([(9, "call now please")], "item_id long, text string")
    model = quality.fit(["good words", "bad *** words"], [1, 0])
    for out, own in (
        (pii.find_pii(df), {"pii"}),
        (langid.identify(df, langid.LanguageModel([("en", "call", 1)])), {"lang_pred", "lang_score"}),
        (quality.score_quality(df, model), {"quality_score"}),
        (decontam.find_leaks(df, items), {"leaks"}),
        (simhash.near_duplicates(df), {"fingerprint", "component_id"}),
    ):
        names = [c.lower() for c in out.columns]
        assert len(names) == len(set(names)) and own <= set(names) and {c.lower() for c in df.columns} <= set(names)
        assert len(out.collect()) == 1
    pages = spark.createDataFrame([(1, "http://a.b/", "<p>hello</p>", "old")], "page_id long, url string, html string, Text string")
    assert [r["text"] for r in html_extract.extract_main_text(pages).collect()] == ["hello"]
