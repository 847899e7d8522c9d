"""The queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontam, exact_dedup, html_extract, langid, lexical, mixing, pii, quality, simhash, token_store, url_filter, warc
from .common import ascii_lower, shared_path, text_or_empty, written

URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["base"])
    counts = [pii.count_of(F.col("pii"), kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(pii.digest(base), 256).alias("base_sha256"), pii.digest(F.col("pii")).alias("spans"), F.array_join(F.transform("pii", lambda s: F.round(s["score"], 3).cast("string")), ",").alias("scores"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_extract.extract_main_text(_table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, url_filter.rules_frame(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = written(_table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words().alias("size")), "sizes")
    mixed = mixing.mix_counts(sizes, size_col="size")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = simhash.add_fingerprint(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint")
    classes = simhash.near_classes(written(prints, "fingerprints"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_store.write_tokens(_table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")), path)
    return token_store.token_index(spark, path)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    hashed = docs.withColumn("text_sha256", F.sha2(ascii_lower(text_or_empty("text")), 256))
    return exact_dedup.exact_dedup(hashed).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels").where(~quality.held_out()))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leak_pairs(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audit(_table(spark, sf_dir, "conversations"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_warc(warc.mark_revisits(_table(spark, sf_dir, "pages").select("page_id", "url", "html")), path)
    return warc.read_warc(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "lexical")
    lexical.build_index(_table(spark, sf_dir, "documents"), path)
    return lexical.search(spark, path, _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii, op2_html_extract, op3_url_filter, op4_mixing, op5_simhash, op6_token_ids, op7_exact_dedup, op8_langid, op9_quality, op10_decontaminate, op11_conversation_repair, op12_warc, op13_lexical_search)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": f"""
        with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages),
        p as (select page_id, rest, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') as host,
                     coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
        rules(verdict, rule, h, t) as (values ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
                     ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
        fits as (select p.page_id, p.host, p.path, r.rule, r.verdict, row_number() over (partition by p.page_id, p.host, p.path order by length(r.rule) desc, r.rule) as k
                 from p left join rules r on (p.host = r.h or ends_with(p.host, '.' || r.h)) and starts_with(p.path, r.t))
        select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from fits where k = 1""",
    "op4_mixing": r"""
        with d as (select doc_id, case when source is null then 'z' else 'a' || source end as key,
                          len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
                          md5('42:' || coalesce(doc_id::varchar, '')) as noise from documents),
        c as (select *, length(bin(size)) * 32 + (size >> greatest(length(bin(size)) - 5, 0)) as class from d),
        s as (select key, sum(size)::bigint as source_size from d group by key),
        w as (select *, [5.0, 2.0, 1.0][((row_number() over (order by key) - 1) % 3 + 1)::int]::double as weight from s),
        r as (select *, source_size / weight as ratio, sum(source_size) over () * 1.5::double as total from w),
        f as (select *, (total - 2.0::double * coalesce(sum(source_size) over b, 0)) / (sum(weight) over () - coalesce(sum(weight) over b, 0.0)) * weight >= 2.0::double * source_size as full_
              from r window b as (order by ratio, key rows between unbounded preceding and 1 preceding)),
        g as (select key, source_size, case when full_ then 2.0::double * source_size else
                (total - 2.0::double * coalesce(sum(source_size) filter (full_) over (), 0)) / sum(weight) filter (not full_) over () * weight end as target from f),
        k as (select c.*, row_number() over (partition by key order by class, substr(noise, 1, 2), noise, doc_id) as place from c),
        e as (select k.doc_id, k.size, g.source_size, g.target, k.place, case when g.source_size > 0 then g.target / g.source_size else 0.0::double end as each,
                     (('0x' || substr(md5('42:' || k.key), 1, 4))::bigint + 0.5::double) / 65536.0::double as shift
              from k join g using (key))
        select doc_id, size, source_size, target, (size * (floor(each * place + shift) - floor(each * (place - 1) + shift)))::bigint as taken from e""",
    "op7_exact_dedup": f"""
        with h as (select doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) as text_sha256 from documents),
        g as (select *, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size from h)
        select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256 from g""",
    "op12_warc": """
        with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hex, sha256(coalesce(html, '')) as key from pages),
        d as (select *, max(page_id) over (partition by key) as keep,
                     array_to_string(list_transform(range(0, 40, 5), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s:
                       substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, i + 1, 5))::bigint >> s) & 31) + 1)::int, 1)), '')), '') as payload_digest from p)
        select page_id, payload_bytes::bigint as payload_bytes, payload_digest, case when page_id is not distinct from keep then 'response' else 'revisit' end as record_type,
               case when page_id is distinct from keep then keep end as refers_to from d""",
    "op13_lexical_search": rf"""
        with t as (select doc_id, row_number() over () as k, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
        d as (select doc_id, k, len(terms)::bigint as n, terms from t where len(terms) > 0),
        c as (select count(*)::bigint as docs, sum(n)::bigint as total from d),
        q as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
        p as (select k, term, count(*)::bigint as tf from (select k, unnest(terms) as term from d) where term in (select term from q) group by k, term),
        f as (select term, count(*)::bigint as df from p group by term),
        w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w from f, c),
        s as (select q.item_id, p.k, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 90 + (90 * d.n * c.docs) // c.total))))::bigint as score
              from q join p using (term) join w using (term) join d on d.k = p.k, c group by q.item_id, p.k),
        r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank, doc_id, score from s join d using (k) where score > 0)
        select item_id, rank, doc_id, score from r where rank <= 10""",
}
