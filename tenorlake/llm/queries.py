"""The thin queries of this subpackage, and their SQL where SQL can express them.

A query runs its operator with production parameters over the whole table and derives the columns that
its contract names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_documents
from .decontamination import find_contamination
from .importance import resample
from .ngram_perplexity import perplexity_rules
from .packing import pack
from .quality_qda import score_quality
from .secrets import scan_secrets
from .simhash_dedup import near_duplicate_classes
from .substring_dedup import remove_repeated_passages
from .toxicity import score_toxicity
from .url_filter import judge_urls
from .warc_revisits import resolve_revisits
from .whitening import whiten

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules that the query op1 is given.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures that follow from ``pages``: each page as a full response, and a not-modified one some time later.

    By page the later capture has the response's ETag, a weak one, none but the date, or another one.
    """
    page, tag = F.col("page_id"), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16)
    full = pages.select((2 * page).alias("record_id"), "url", page.alias("at"), F.lit(200).alias("http_status"), tag.alias("etag"), F.floor(page / 1000).cast("string").alias("last_modified"))
    later = full.select(F.col("record_id") + 1, "url", (F.col("at") + 1 + F.col("at") % 9000).alias("at"), F.lit(304), F.when((F.col("at") % 4) == 0, F.col("etag")).when((F.col("at") % 4) == 1, F.concat(F.lit("W/"), "etag")).when((F.col("at") % 4) == 3, F.concat(F.lit("x"), "etag")), "last_modified")
    rows = full.union(later)
    headers = F.create_map(F.lit("Content-Type"), F.when(F.col("http_status") == 200, "text/html").otherwise("text/plain"), F.lit("Date"), F.col("at").cast("string"), F.lit("ETag"), F.col("etag"))
    return rows.withColumn("headers", F.map_filter(headers, lambda k, v: v.isNotNull()))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(captures_of(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    merged = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select("record_id", "url_key", "at", "refers_to", "status", merged.alias("headers"))


def op3_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op7_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity_rules(table(spark, sf_dir, "documents"))


def op9_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), WORD_BPE, digests=True)


def spans_text(spans):
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), BYTE_BPE)


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_warc_revisits,
        op3_toxicity_lexicon,
        op4_substring_dedup,
        op5_simhash_dedup,
        op6_string_tiling,
        op7_quality_qda,
        op8_ngram_perplexity,
        op9_bpe_segment_tree,
        op10_secret_scan,
        op11_whitening,
        op12_importance_resampling,
        op13_best_fit_packing,
    )
}

#: Oracles where SQL can express the operator. The others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op2_warc_revisits": r"""
with page as (
    select page_id, url, substring(md5(coalesce(html, '')), 1, 16) as tag, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare
    from pages),
keyed as (
    select page_id, tag,
        regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^(?:www|m)\.', '')
        || regexp_replace(regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/index\.html?$', '/'), '/+$', '') as stem,
        list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(?:utm_[a-z]+|ref|fbclid|gclid)(?:=|$)'))) as query
    from page),
named as (select page_id, tag, stem || case when len(query) > 0 then '?' || array_to_string(query, '&') else '' end as url_key, cast(page_id // 1000 as varchar) as modified from keyed),
met as (
    select r.page_id, r.url_key, r.page_id + 1 + r.page_id % 9000 as "at", s.page_id as found, s.tag as stored, s.modified as stored_modified, r.modified,
        case r.page_id % 4 when 0 then r.tag when 1 then r.tag when 3 then 'x' || r.tag end as bare_tag,
        case r.page_id % 4 when 0 then r.tag when 1 then 'W/' || r.tag when 3 then 'x' || r.tag end as own_tag,
        row_number() over (partition by r.page_id order by s.page_id desc nulls last) as n
    from named r left join named s on s.url_key = r.url_key and s.page_id < r.page_id + 1 + r.page_id % 9000),
judged as (
    select *, case when found is null then 'orphan' when coalesce(bare_tag = stored, modified = stored_modified) then 'resolved'
        when coalesce(bare_tag = stored, modified = stored_modified) is null then 'unchecked' else 'mismatch' end as status
    from met where n = 1)
select 2 * page_id + 1 as record_id, url_key, "at", 2 * found as refers_to, status,
    case when status in ('resolved', 'unchecked') then 'content-type=text/html;date=' || "at" || ';etag=' || coalesce(own_tag, stored) end as headers
from judged
""",
    "op4_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
starts as (select doc_id, w, unnest(generate_series(1, len(w) - 12)) as i from d where len(w) >= 13),
windows as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as words from starts),
firsts as (select words, min(doc_id) as least from windows group by words),
gone as (select distinct doc_id, i + k as pos from windows join firsts using (words), range(13) r(k) where least < doc_id),
word as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from d),
kept as (select doc_id, string_agg(word, ' ' order by pos) as text, count(*) as n from word anti join gone using (doc_id, pos) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept using (doc_id)
""",
    "op12_importance_resampling": r"""
with crc as (  -- the table of CRC-32 by its rule
    select list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c % 2 = 1 then xor(3988292384, c // 2) else c // 2 end) order by i) as t
    from (select cast(unnest(range(256)) as bigint) as i)),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
target as (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark),
used as (select doc_id, word, count(*) as n from (select doc_id, unnest(w) as word from d) group by all),
digits as (select word, list_transform(string_split(hex(encode(word)), ''), lambda x: cast(instr('123456789ABCDEF', x) as bigint)) as x from (select word from used union select word from target)),
hashed as (
    select word, xor(4294967295, list_reduce([4294967295] || list_transform(range(1, len(x), 2), lambda i: 16 * x[i] + x[i + 1]), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) % 10000 as bucket
    from digits, crc),
own as (select bucket, sum(n) as n from used join hashed using (word) group by bucket),
wanted as (select bucket, count(*) as n from target join hashed using (word) group by bucket),
total as (select (select coalesce(sum(n), 0) from own) as s, (select count(*) from target) as t),
gain as (
    select b.bucket, floor(1000 * ln(cast((coalesce(wanted.n, 0) + 1) * (total.s + 10000) as double) / cast((coalesce(own.n, 0) + 1) * (total.t + 10000) as double))) as gain
    from (select distinct bucket from hashed) b left join own using (bucket) left join wanted using (bucket), total),
weighed as (select doc_id, cast(sum(n * gain) as bigint) as weight from used join hashed using (word) join gain using (bucket) group by doc_id),
scored as (
    select d.doc_id, cast(len(w) as bigint) as n_features, coalesce(weight, 0) as weight,
        coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substring(sha256('2024:' || d.doc_id), 1, 8) as bigint) + 0.5) / 4294967296))) as bigint) as score
    from d left join weighed using (doc_id)),
placed as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () * 10 // 100 as drawn from scored where n_features >= 20)
select s.*, case when place <= drawn then place end as rank from scored s left join placed using (doc_id)
""",
}
