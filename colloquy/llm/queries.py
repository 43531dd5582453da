"""Queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.llm import decontamination, language_id, line_dedup, media, ngram_join, packing, pii, toxicity, url_filters, warc
from colloquy.llm.common import table


def op1_language_id(spark, sf_dir):
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op2_url_filters(spark, sf_dir):
    return url_filters.filter_urls(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark, sf_dir):
    return line_dedup.clean_lines(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_join(spark, sf_dir):
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op6_pii(spark, sf_dir):
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[pii.counted(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"),
    )


def op7_best_fit_packing(spark, sf_dir):
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_warc(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages"), min_revisit_bytes=0)


def op9_media_columns(spark, sf_dir):
    facts = media.media_columns(table(spark, sf_dir, "documents"))
    return facts.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", media.feature_digest().alias("feature")
    )


def op10_benchmark_decontamination(spark, sf_dir):
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


QUERIES = {f.__name__: f for f in (op1_language_id, op2_url_filters, op3_line_dedup, op4_toxicity, op5_ngram_join, op6_pii, op7_best_fit_packing, op8_warc, op9_media_columns, op10_benchmark_decontamination)}

ORACLES = {
    # alias groups by a recursive walk over the declared edges
    "op2_url_filters": r"""
with recursive
  rules(rule, rhost, rpath, rverdict) as (values
    ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
    ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'),
    ('org/es/', 'org', '/es/', 'block')),
  bare as (select page_id, url, html, regexp_extract(url, '(?s)^([^#]*)', 1) as b from pages),
  addressed as (
    select page_id, url, html,
      case when regexp_extract(b, '(?s)^(.*?://[^/?#]*)', 1) <> '' then
        translate(regexp_extract(b, '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
        || substr(b, length(regexp_extract(b, '(?s)^(.*?://[^/?#]*)', 1)) + 1) end as node
    from bare),
  tags as (
    select url, node, regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) as t
    from (select url, node, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')) as tag from addressed) l
    where regexp_matches(tag, '(?is)\brel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|''(?:[^'']*\s)?canonical(?:\s[^'']*)?''|canonical[\s/>])')
    union all
    select url, node, regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)
    from (select url, node, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')) as tag from addressed) m),
  targets as (
    select node, trim(replace(t, '&amp;', '&')) as t, regexp_extract(url, '(?s)^(.*?:)//', 1) as scheme, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) as origin,
      regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1) as folder
    from tags),
  resolved as (
    select node, regexp_extract(case when contains(t, '://') then t when starts_with(t, '//') then scheme || t when starts_with(t, '/') then origin || t
      when t <> '' then folder || case when ends_with(folder, '/') then '' else '/' end || t end, '(?s)^([^#]*)', 1) as b
    from targets),
  edges as (
    select node as u, translate(regexp_extract(b, '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
        || substr(b, length(regexp_extract(b, '(?s)^(.*?://[^/?#]*)', 1)) + 1) as v
    from resolved where contains(b, '://')),
  both_ways as (select u, v from edges union select v, u from edges),
  reach(node, other) as (
    select u, u from both_ways union select r.node, b.v from reach r join both_ways b on r.other = b.u),
  nodes as (select distinct other as node from reach union select node from addressed),
  fitted as (
    select node, rule, rverdict, row_number() over (partition by node order by length(rhost || rpath) desc) as n
    from (select node, coalesce(translate(regexp_extract(node, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as h,
                 coalesce(regexp_extract(node, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as p from nodes where node is not null) s
    join rules on (h = rhost or ends_with(h, '.' || rhost)) and starts_with(p, rpath)),
  groups as (select node, min(other) as component from reach group by node),
  decided as (
    select component, case when bool_or(rverdict = 'allow') then 'allow' when bool_or(rverdict = 'block') then 'block' else 'allow' end as shared
    from groups left join (select * from fitted where n = 1) f using (node) group by component)
select page_id,
  coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
  rule, coalesce(rverdict, shared, 'allow') as verdict, component
from addressed a left join (select * from fitted where n = 1) f on a.node = f.node
left join groups g on a.node = g.node left join decided using (component)
""",
    "op8_warc": """
with p as (select page_id, coalesce(html, '') as body from pages),
first as (select body, min(page_id) as first_id from p group by body)
select page_id, cast(strlen(p.body) as bigint) as payload_bytes,
  (select string_agg(translate(lpad(to_base(cast('0x' || substr(sha1(p.body), 1 + 10 * i, 10) as bigint), 32), 8, '0'),
     '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'), '' order by i) from range(4) r(i)) as payload_digest,
  case when page_id > first_id then 'revisit' else 'response' end as record_type,
  case when page_id > first_id then first_id end as refers_to
from p join first using (body)
""",
}
