"""Each corpus operator against a brute-force version, an exact round trip or held-out accuracy, and on awkward rows."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest

from sparkloom.llm import components, decontam, exact_dedup, html_extract, langid, mixing, pii, quality, range_coder, simhash, token_store, url_filter

SF = "/root/testdata/sf0.001"
AWKWARD = [(1, None, None, None, 0), (2, "", "en", "b", 0), (3, "a b c", "en", "b", 5), (3, "a b c", "en", "b", 5), (4, "x " * 30_000, "de", None, 9), (None, "A b C", None, "a", 5), (6, "\u00e9\U0001f600 42 a@b.co", "fr", "a", 9)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---- op 1


def brute_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_pii_base_spans_are_those_of_the_patterns():
    rng = random.Random(5)
    parts = ["a.b@c.d", "@", ".", "1", "255", "256", " ", "-", "+1", "(555)", "4111 1111 1111 1111", "4568668072826647", "10.0.0.1", "x", "é", "a@b", "@b.c", "+49 30 1234567", "0001.2.3.4"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert [s[:3] for s in pii.spans_of(text) if s[3]] == brute_base(text), text


def test_pii_checksums_and_context():
    assert [s[0] for s in pii.spans_of("IBAN DE89 3704 0044 0532 0130 00 ok")] == ["iban"]
    assert not pii.spans_of("IBAN DE88 3704 0044 0532 0130 00 ok")
    assert [s[0] for s in pii.spans_of("my social security number 123-45-6789")] == ["ssn"]
    assert not pii.spans_of("part 123-45-6789")
    assert pii.spans_of("call +1 (212) 555-1234")[0][4] > pii.spans_of("xxx +1 (212) 555-1234")[0][4]


def test_pii_long_runs_take_linear_time():
    assert pii.spans_of("1" * 300_000) == [] and pii.spans_of("a" * 300_000) == [] and pii.spans_of("+1" * 100_000) == []


def test_pii_awkward(awkward, empty):
    found = rows(pii.find_pii(awkward))
    assert len(found) == len(AWKWARD) and {r["doc_id"] for r in found if r["pii"]} == {6}
    assert (found[-1]["pii"][0]["start"], found[-1]["pii"][0]["end"]) == (6, 12)
    assert pii.find_pii(empty).count() == 0
    assert [r["text"] for r in rows(pii.redact(awkward)) if r["doc_id"] == 6] == ["\u00e9\U0001f600 42 <email>"]


# ---- op 2

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><p>Site</p></header>
<nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- x <p>no</p> -->
<div class="layout"><aside>Side</aside><article class="post-17"><h1>Head &amp; line</h1><p>One   two<br>three<p>Four <b>five</b> &lt;six&gt;
<div class="ad">Buy</div><form><p>Mail</p></form><ul><li>item a<li>item b</ul><div id="comments"><p>First!</p></div></article></div><footer>&copy; x</footer></body></html>"""


def test_html_article_only(spark, empty):
    pages = spark.createDataFrame([(1, "http://h.x/a", PAGE), (2, None, None), (3, "http://h.x/b", ""), (4, "http://h.x/c", "<p>bare &eacute;"), (1, "http://h.x/a", PAGE)], "page_id long, url string, html string")
    got = [(r["page_id"], r["text"]) for r in rows(html_extract.extract_main_text(pages).orderBy("page_id"))]
    text = "Head & line\nOne two three\nFour five <six>\nitem a\nitem b"
    assert got == [(1, text), (1, text), (2, ""), (3, ""), (4, "bare é")]
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


def test_html_host_votes_choose_the_path(spark):
    body = "<div class='box-1'>{}</div><div class='story'>{}</div>"
    pages = [(i, "http://n.x/", body.format("teaser " * 3, "long text here " * 40)) for i in range(9)] + [(9, "http://n.x/", body.format("teaser " * 200, "short story"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert [r["text"] for r in rows(html_extract.extract_main_text(df, share=0.5)) if r["page_id"] == 9] == ["short story"]


def test_html_pages_hold_their_articles(spark):
    for r in rows(html_extract.extract_main_text(spark.read.parquet(f"{SF}/pages.parquet"))):
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        import html as h

        want = [" ".join(h.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(w for w in want if w)


# ---- op 3


def test_urls_against_brute_force(spark):
    rng = random.Random(3)
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"), ("block", "a.example.net/en/x"), ("allow", "a.example.net/")]
    hosts = ["net", "NET", "xnet", "example.net", "a.example.net", "b.a.example.net", "example-a.net", "com", "w.example.com", "org", "q.org", "", "..net", "net.", "notexample.net"]
    urls = [(i, f"{rng.choice(['http://', 'https://', '', 'x://y://'])}{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/xy', '/de/1', '/fr/', '?/en/', '#/'])}{rng.choice(['', '?q=/', '#f'])}") for i in range(600)] + [(None, None), (700, None)]

    def judge(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        best = max(((len(r), r, v) for v, r in rules if (host == (h := r.partition("/")[0]) or host.endswith("." + h)) and path.startswith("/" + r.partition("/")[2])), default=None)
        return host, path, best and best[1], best[2] if best else "allow"

    df = spark.createDataFrame(urls, "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows(url_filter.judge_urls(df, url_filter.rules_frame(spark, rules), runs=8))}
    assert got == {i: judge(u) for i, u in urls}
    clash = url_filter.judge_urls(df.withColumnRenamed("page_id", "Host"), url_filter.rules_frame(spark, rules).limit(0), "Host", runs=4)
    assert {r["verdict"] for r in rows(clash)} == {"allow"} and clash.columns == ["url", "host", "path", "rule", "verdict"]


# ---- op 4


def test_mixing_targets_and_counts(spark, docs):
    got = rows(mixing.mix_counts(docs))
    sizes = Counter()
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and 0 <= r["copies"] <= 2
        sizes[r["source"]] += r["size"]
    names = sorted(sizes)
    weights = dict(zip(names, (5, 2, 1) * len(names), strict=False))
    left, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:  # share by weight, stop at twice the size, again
        level = left / sum(weights[n] for n in free)
        full = {n for n in free if level * weights[n] >= 2 * sizes[n]}
        for n in full or free:
            target[n] = 2.0 * sizes[n] if full else level * weights[n]
        left -= sum(2 * sizes[n] for n in full)
        free = free - full if full else set()
    for n in names:
        mine = [r for r in got if r["source"] == n]
        assert {r["source_size"] for r in mine} == {sizes[n]} and abs(mine[0]["target"] - target[n]) < 1e-6
        assert abs(sum(r["size"] * r["copies"] for r in mine) - target[n]) <= 2 * max(r["size"] for r in mine)


def test_mixing_awkward(awkward, empty):
    got = rows(mixing.mix_counts(awkward.withColumnRenamed("n_chars", "Copies")))
    assert len(got) == len(AWKWARD) and sorted(r["size"] for r in got) == [0, 0, 3, 3, 3, 3, 30_000]
    assert mixing.mix_counts(empty).count() == 0 and mixing.mix(empty).columns == empty.columns
    mixed = Counter(r["doc_id"] for r in rows(mixing.mix(awkward)))
    assert mixed[4] == sum(r["copies"] for r in got if r["doc_id"] == 4)


# ---- op 5


def reach(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprint_by_the_definition():
    from xxhash import xxh64_intdigest

    for text in ["One two  THREE\tfour five é", "a b", "x", "", None, " \x0b ", "a a a a a"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_spark_hash_is_the_same_function(spark):
    from xxhash import xxh64_intdigest

    for s in ["", "a b c", "é" * 40]:
        assert spark.sql("select xxhash64(:s) as h", args={"s": s}).first()["h"] % (1 << 64) == xxh64_intdigest(s.encode(), 42)


def test_near_links_lose_none(spark):
    rng = random.Random(1)
    prints = [rng.getrandbits(64) for _ in range(300)]
    for _ in range(900):  # chains and dense clusters
        p = rng.choice(prints)
        for _ in range(rng.randint(1, 5)):
            p ^= 1 << rng.randrange(64)
        prints.append(p)
    base = rng.getrandbits(64)
    prints += [base ^ rng.getrandbits(11) << 20 for _ in range(700)]
    ids = list(range(len(prints)))
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in zip(ids, prints, strict=True)], "doc_id long, fingerprint long")
    want = reach(ids, [(a, b) for a, b in combinations(ids, 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
    assert {r["doc_id"]: r["component_id"] for r in rows(simhash.near_classes(df))} == want


def test_large_cells_are_linked_like_small_ones(monkeypatch):
    fps = np.random.default_rng(0).integers(0, 1 << 13, 900, dtype=np.uint64).astype(np.uint64) * np.uint64(0x10001)
    fps = np.unique(fps)
    out = []
    for limit in (10_000, 16):
        monkeypatch.setattr(simhash, "PAIRWISE", limit)
        forest = simhash._Forest(len(fps))
        simhash._link_cell(fps, forest, np.arange(len(fps)))
        out.append(forest.root.tolist())
    assert out[0] == out[1]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in rows(components.components(spark.createDataFrame(links, "u long, v long")))}
    want = reach(range(600), [(a, b) for a, b in links if a is not None])
    assert got == {n: want[n] for a, b in links if a is not None and a != b for n in (a, b)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_awkward(awkward, empty):
    got = rows(simhash.near_duplicates(awkward))
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 3, 4: 4, None: 3, 6: 6}
    kept = rows(simhash.drop_near_duplicates(awkward))
    assert sorted(r["doc_id"] for r in kept) == [1, 3, 4, 6] and list(kept[0]) == awkward.columns
    assert simhash.near_duplicates(empty).count() == 0


# ---- op 6


def test_range_coder_round_trips():
    rng = np.random.default_rng(0)
    for ids in ([], [0], [2**32 - 1], [7] * 3000, range(5000), rng.integers(0, 49408, 3000), rng.zipf(1.3, 40_000) % 49408, np.tile([1, 2, 3], 999)):
        ids = np.array(ids, np.int64)
        frame = range_coder.encode(ids)
        assert (range_coder.decode(frame) == ids).all()
        for at in (0, 5, len(frame) // 2, len(frame) - 1):
            with pytest.raises(ValueError):
                range_coder.decode(frame[:at] + bytes([frame[at] ^ 1]) + frame[at + 1 :])
    frame = range_coder.encode(rng.zipf(1.5, 60_000) % 5000)
    assert len(frame) < 60_000


def test_contexts_save_a_tenth_over_frequencies(spark):
    ids = np.concatenate([np.array(x) for x in expected_ids(r["text"] for r in rows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id")))])
    often = np.bincount(ids)
    share = often[often > 0] / len(ids)
    assert 8 * len(range_coder.encode(ids)) / len(ids) < 0.9 * -(share * np.log2(share)).sum()


def test_other_tokenizers_take_whole_texts():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path, texts = str(public_tokenizers.path("byte_bpe_50k.json")), ["Hello  WORLD\n\n it's", "", " a b "]
    ids, sizes = token_store._encoder(path)(pa.array(texts))
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]


def test_forgetting_words_changes_no_ids(monkeypatch):
    import public_tokenizers
    import pyarrow as pa

    monkeypatch.setattr(token_store, "REMEMBERED", 40)
    encode, rng = token_store._WordEncoder(str(public_tokenizers.path("word_bpe_49k.json"))), random.Random(2)
    for _ in range(60):
        texts = ["".join(rng.choice("aàbcéñßst''re019!?.,-~\u2019\u0301 \n") for _ in range(rng.randint(0, 60))) for _ in range(5)]
        ids, sizes = encode(pa.array(texts))
        want = [w[:-1] for w in expected_ids(texts)]
        assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]


def expected_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    return [[*e.ids, 2] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def stored(spark, df, tmp_path, **params):
    import public_tokenizers

    out = str(tmp_path / "tokens")
    token_store.write_tokens(df, str(public_tokenizers.path("word_bpe_49k.json")), out, **params)
    return out


def test_tokens_round_trip(spark, docs, tmp_path):
    out = stored(spark, docs, tmp_path, frame_ids=20_000)
    local = sorted(rows(docs), key=lambda r: r["doc_id"])
    want, start = {}, 0
    for r, ids in zip(local, expected_ids(r["text"] for r in local), strict=True):
        want[r["doc_id"]] = (start, len(ids), crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    assert {r["doc_id"]: r["ids"] for r in rows(token_store.read_tokens(spark, out))} == {k: v[3] for k, v in want.items()}
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(token_store.token_index(spark, out))} == {k: v[:3] for k, v in want.items()}


def test_tokens_awkward(spark, awkward, empty, tmp_path):
    texts = ["e\u0301 caf\u00e9 \u0130I", "a\u00a0b\u2003c", "<|endoftext|> x<|startoftext|>y", "don't  DON'T 's", "\u4e2d\u6587 \u0e44\u0e17\u0e22", "\x1c\x1d\x85z \x0b\x0c", "\u0301a \u200d\u0301", "J\u030c j\u030c H\u0331", "<|ENDOFTEXT|> A", "\u212a K"]
    odd = spark.createDataFrame([*AWKWARD, *[(100 + i, t, None, None, 0) for i, t in enumerate(texts)]], DOCS)
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in rows(token_store.read_tokens(spark, stored(spark, odd, tmp_path / "a"))))
    local = rows(odd)
    assert got == Counter((r["doc_id"], tuple(ids)) for r, ids in zip(local, expected_ids(r["text"] for r in local), strict=True))
    assert token_store.token_index(spark, stored(spark, empty, tmp_path / "b")).count() == 0


# ---- op 7


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_exact_dedup_against_brute_force(spark, limit):
    rng = random.Random(4)
    data = [(i, rng.choice(["", None, "Ab", "aB", "AB ", "Éa", "éa", "x" * 100 + rng.choice("abC"), "X" * 100 + rng.choice("abc")]), "k") for i in range(300)] + [(5, "Ab", "k"), (None, "solo", "k"), (None, "Ab", "k")]
    df = spark.createDataFrame(data, "doc_id long, text string, Kept string")
    groups = {}
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for i, t, _ in data:
        groups.setdefault(low(t), []).append(i)
    want = Counter()
    for i, t, _ in data:
        g = groups[low(t)]
        keep = max((x for x in g if x is not None), default=None)
        want[(i, t, keep, len(g), keep == i)] += 1
    got = exact_dedup.exact_dedup(df, broadcast_bytes=limit)
    assert got.columns == ["doc_id", "text", "keep_id", "group_size", "kept"] and Counter(tuple(r) for r in got.collect()) == want
    assert exact_dedup.drop_copies(df).columns == df.columns and exact_dedup.exact_dedup(df.limit(0)).count() == 0


# ---- op 8 and 9


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()))
    got = [r for r in rows(langid.identify(docs.where(langid.held_out()), model)) if r["lang"] is not None and len(r["text"] or "") > 60]
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97


def test_language_awkward(awkward, empty, docs):
    model = langid.train(docs, per_language=50)
    got = rows(langid.identify(awkward, model))
    assert [r["lang_pred"] == "und" for r in got] == [True, True, False, False, False, False, False]
    assert all(0 <= r["lang_score"] <= 1 for r in got)
    assert langid.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in rows(langid.identify(awkward, langid.train(empty)))} == {"und"}
    assert langid.keep_identified(awkward, model, least=0.0).count() == 5


def test_language_backs_off_to_shorter_grams():
    model = langid.LanguageModel([("aa", "zebra", 5), ("bb", "quilt", 5)])
    assert model.languages[int(model.word("zebras").argmax())] == "aa" and model.languages[int(model.word("quil").argmax())] == "bb"
    assert not model.word("\u4e2d").any()


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where(~quality.held_out()), most=1500)
    got = rows(quality.score_quality(docs.join(labels, "doc_id").where(quality.held_out()), model))
    good, bad = [r["quality_score"] for r in got if r["quality"] == 1], [r["quality_score"] for r in got if r["quality"] == 0]
    assert np.mean(np.array(good)[:, None] > np.array(bad)[None, :]) > 0.9


def test_quality_awkward(awkward, empty):
    model = quality.fit(["good words here", "*** !!! ###", None], [1, 0, 1])
    got = rows(quality.score_quality(awkward, model))
    assert len(got) == len(AWKWARD) and all(0 <= r["quality_score"] <= 1 for r in got)
    assert quality.score_quality(empty, model).count() == 0 and abs(rows(quality.score_quality(awkward, quality.fit([], [])))[0]["quality_score"] - 0.5) < 1e-9


# ---- op 10


def brute_align(a, b):
    best, above = 0.0, [0.0] * (len(b) + 1)
    for x in a:
        row = [0.0]
        for j, y in enumerate(b):
            row.append(max(0.0, above[j] + (1.0 if x == y else -0.5), above[j + 1] - 0.5, row[j] - 0.5))
        best, above = max(best, *row), row
    return best


def test_alignment_against_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        assert abs(decontam.align(np.array(a), np.array(b)) - brute_align(a, b)) < 1e-9


def test_leaks_against_brute_force(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in rows(decontam.leak_pairs(docs, bench))}
    local, items = rows(docs), rows(bench)
    words = lambda t: [w for x in (t or "").split() if (w := decontam.normal(x))]
    want = set()
    for d in local:
        text = words(d["text"])
        held = set(zip(text, text[1:], text[2:], strict=False))
        for i in items:
            item = words(i["text"])
            if len(item) >= 3 and held & set(zip(item, item[1:], item[2:], strict=False)) and brute_align(item, text) / len(item) >= 0.5:
                want.add((d["doc_id"], i["item_id"]))
    assert want and got == want


def test_edited_copies_are_found_and_blocks_agree(spark, awkward, empty):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=30))) for i in range(40)] + [(90, None), (91, "w1 w2"), (None, " ".join(rng.choices(vocabulary, k=20)))]
    data, want = [], set()
    for n in range(120):
        text = rng.choices(vocabulary, k=rng.randint(20, 300))
        if n % 3 == 0:
            i, item = items[n % 40]
            copy = [rng.choice(vocabulary) if rng.random() < 0.12 else w.upper() + "," for w in item.split()]
            at = rng.randint(0, len(text))
            text[at:at] = copy
            want.add((n, i))
        data.append((n, " ".join(text)))
    df, bench = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (decontam.BLOCK_BYTES, 2000):
        assert {(r["doc_id"], r["item_id"]) for r in rows(decontam.leak_pairs(df, bench, block_bytes=block))} == want
    assert decontam.drop_leaks(df, bench).count() == 120 - len({d for d, _ in want})
    assert decontam.drop_leaks(awkward, bench).count() == len(AWKWARD) and decontam.leak_pairs(empty, bench).count() == 0
    assert decontam.leak_pairs(df, bench.limit(0)).count() == 0


def test_a_passage_in_every_document_is_still_found(spark):
    item = " ".join(f"p{i}" for i in range(20))
    df = spark.createDataFrame([(n, f"x{n} {item} y{n}") for n in range(60)], "doc_id long, text string")
    assert decontam.leak_pairs(df, spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 60


def test_digest_of_no_spans(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(pii.digest(F.array().cast(pii.SPANS)).alias("d")).first()
    assert row["d"] == "" and hashlib.sha256(b"").hexdigest().startswith("e3b0")
