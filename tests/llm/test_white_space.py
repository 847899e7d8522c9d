"""Words parted by any white space are the same words, in items, documents, training and scoring."""

import re

import pyarrow as pa

from sparkloom.llm import common, decontam, quality

WIDE = " 　 \u0085 \x1c"


def test_wide_words_are_those_of_str_split():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert [c for c in every if c.isspace()] == [c for c in every if c in "\t\n\v\f\r " or re.match(common.WIDE_SPACE, c)]
    texts = ["a　b  c ", None, " ", "plain words", "x\u0085y\x1cz", *[f"a{c}b" for c in every if c.isspace() or 0x2000 <= ord(c) < 0x2100]]
    found, codes, words = common.words_of(pa.array(texts), wide=True)
    assert [[words[c] for c in codes[found == i]] for i in range(len(texts))] == [(t or "").split() for t in texts]


def test_leaks_across_wide_spaces(spark):
    words = [[f"{k}{i}" for i in range(20)] for k in "pq"]
    bench = spark.createDataFrame([(1, " ".join(words[0])), (2, "　".join(words[1]))], "item_id long, text string")
    df = spark.createDataFrame([*[(n, s.join(words[0])) for n, s in enumerate(WIDE)], (9, " ".join(words[1]))], "doc_id long, text string")
    assert {tuple(r) for r in decontam.leak_pairs(df, bench).collect()} == {*[(n, 1, 1.0) for n in range(len(WIDE))], (9, 2, 1.0)}
    assert decontam.drop_leaks(df, bench).count() == 0


def test_quality_across_wide_spaces(spark):
    model = quality.fit(["good words here", "*** !!! ###"] * 8, [1, 0] * 8)
    df = spark.createDataFrame([(s.join(["good", "words", "here"]),) for s in " " + WIDE], "text string")
    assert len({r["quality_score"] for r in quality.score_quality(df, model).collect()}) == 1
