"""Keyword, vector and fused search."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalogue.common import SEG, Register
from colloquy.functions.vectors import dot
from colloquy.plans import retrieval as ret
from colloquy.sources.tables import segments as read_segments
from colloquy.sources.tables import table

query = Register()

QUESTION = "What is the state of the ontion and the thing?"
TERMS = ret.query_words(QUESTION)


def _bm25_sql(source: str, key: str) -> str:
    """BM25 over unstemmed tokens that begin with a query word."""
    f = ", ".join(f"len(list_filter(t, lambda x: starts_with(x, '{w}'))) as f{k}" for k, w in enumerate(TERMS))
    n = ", ".join(f"count(*) filter (f{k} > 0) as n{k}" for k in range(len(TERMS)))
    idf = [f"(case when ln((nn - n{k} + 0.5) / (n{k} + 0.5)) <= 0 then 1e-6 else ln((nn - n{k} + 0.5) / (n{k} + 0.5)) end)" for k in range(len(TERMS))]
    score = " + ".join(f"case when f{k} > 0 then {idf[k]} * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / avgdl)) else 0 end" for k in range(len(TERMS)))
    some = " or ".join(f"f{k} > 0" for k in range(len(TERMS)))
    return f"""tok as (select {key} as id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from {source}), cnt as (select id, len(t) as dl, {f} from tok),
st as (select count(*) as nn, avg(dl) as avgdl, {n} from cnt), kw as (select id, {score} as keyword_score from cnt, st where {some})"""


@query(f"with {_bm25_sql('documents', 'doc_id')} select id, round(keyword_score, 6) as keyword_score, cast(row_number() over (order by keyword_score desc, id) as integer) as keyword_rank from kw order by keyword_score desc, id limit 10")
def bm25_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = ret.bm25(docs, [[w] for w in TERMS], stemmed=False)
    return ret.with_rank(found, "keyword_score", "keyword_rank", 10, F.col("id")).select("id", F.round("keyword_score", 6).alias("keyword_score"), "keyword_rank")


#: A fixed unit vector: the first axis and the second one.
VECTOR = [0.6, 0.8] + [0.0] * 62
_DOT = "list_dot_product(cast(embedding as double[]), cast([" + ", ".join(map(str, VECTOR)) + "] as double[]))"


@query(f"select vec_id, round({_DOT}, 6) as dense_score, cast(row_number() over (order by {_DOT} desc, vec_id) as integer) as dense_rank from embeddings order by dense_score desc, vec_id limit 10")
def knn_topk(spark, sf_dir):
    scored = table(spark, sf_dir, "embeddings").select("vec_id", dot(F.col("embedding"), F.array(*[F.lit(x) for x in VECTOR])).alias("dense_score"))
    return ret.with_rank(scored, "dense_score", "dense_rank", 10, F.col("vec_id")).select("vec_id", F.round("dense_score", 6).alias("dense_score"), "dense_rank")


FUSION = f"""with {_bm25_sql('documents', 'doc_id')},
k as (select id, row_number() over (order by keyword_score desc, id) as keyword_rank from kw order by keyword_score desc, id limit 24),
v as (select vec_id as id, row_number() over (order by {_DOT} desc, vec_id) as dense_rank from embeddings order by {_DOT} desc, vec_id limit 24),
m as (select coalesce(k.id, v.id) as id, keyword_rank, dense_rank, coalesce(1.0 / (60 + keyword_rank), 0) + coalesce(1.0 / (60 + dense_rank), 0) as score from k full outer join v on k.id = v.id),
r as (select *, row_number() over (order by score desc, keyword_rank nulls last, dense_rank nulls last) as rank from m)"""


def _fused(spark, sf_dir, limit):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    key = [F.lit("segment").alias("ref_type"), F.col("id").alias("ref_id"), F.lit("all").alias("source_id")]
    kw = ret.with_rank(ret.bm25(docs, [[w] for w in TERMS], stemmed=False), "keyword_score", "keyword_rank", 3 * limit, F.col("id")).select(*key, "keyword_score", "keyword_rank")
    scored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), dot(F.col("embedding"), F.array(*[F.lit(x) for x in VECTOR])).alias("dense_score"))
    dn = ret.with_rank(scored, "dense_score", "dense_rank", 3 * limit, F.col("id")).select(*key, "dense_score", "dense_rank")
    return ret.reciprocal_rank_fusion(kw, dn, limit)


@query(FUSION + " select id, cast(keyword_rank as integer) as keyword_rank, cast(dense_rank as integer) as dense_rank, round(score, 6) as score, cast(rank as integer) as rank, case when keyword_rank is not null and dense_rank is not null then 'both' when keyword_rank is not null then 'keyword' else 'dense' end as found_by from r where rank <= 8")
def rrf_fusion(spark, sf_dir):
    told = _fused(spark, sf_dir, 8)
    return told.select(F.col("ref_id").alias("id"), "keyword_rank", "dense_rank", F.round("score", 6).alias("score"), "rank", "found_by")


SEGTEXT = f"{SEG}, st0 as (select cast(source_id as varchar) || '::seg' || lpad(cast(segment_index as varchar), 4, '0') as sid, source_id, segment_index, text from seg)"


@query(f"""with {SEGTEXT}, {_bm25_sql('st0', 'sid')},
h as (select sid, source_id, segment_index, row_number() over (order by keyword_score desc, sid) as rank from kw join st0 on kw.id = st0.sid order by keyword_score desc, sid limit 8),
near as (select s.sid, min(h.rank) as rank, any_value(s.segment_index) as segment_index from h join st0 s on s.source_id = h.source_id and abs(s.segment_index - h.segment_index) <= 1 where s.sid not in (select sid from h) group by s.sid),
a as (select sid, 0 as part, rank, 0 as pos from h union all select sid, 1, rank, segment_index from near)
select sid as ref_id, cast(row_number() over (order by part, rank, pos) as integer) as position, part = 1 as is_neighbour from a order by part, rank, pos limit 24""")
def keyword_with_neighbours(spark, sf_dir):
    """The keyword half with neighbours; flows.hybrid_search runs both halves."""
    seg = read_segments(spark, sf_dir)
    hits = ret.bm25(seg.select(F.lit("segment").alias("ref_type"), F.col("segment_id").alias("ref_id"), "source_id", "text"), [[w] for w in TERMS], stemmed=False)
    ranked = ret.with_rank(hits, "keyword_score", "rank", 8, F.col("ref_id"))
    return ret.expand_with_neighbours(ranked, seg).select("ref_id", "position", "is_neighbour")


@query()
def porter_bm25(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return ret.with_rank(ret.bm25(docs, ret.query_phrases(QUESTION)), "keyword_score", "keyword_rank", 10, F.col("id")).select("id", "keyword_score", "keyword_rank")


@query(f"""with {SEG}, cited as (select source_id, segment_index, text, row_number() over (partition by source_id order by segment_index) as position from seg)
select c.source_id, c.segment_index from seg c join cited s on s.source_id = c.source_id and s.position = 1 where contains(s.text, trim(substring(c.text, 1, 12))) and trim(substring(c.text, 1, 12)) <> ''""")
def verified_claims(spark, sf_dir):
    """Claims of every conversation, checked against the source they cite, here its first segment."""
    from colloquy.functions.text import verify_quote
    from colloquy.operators.relational import first_per_key

    seg = read_segments(spark, sf_dir)
    cited = first_per_key(seg, ["source_id"], F.col("segment_index")).select("source_id", F.col("text").alias("cited"))
    return seg.join(cited, "source_id").where(verify_quote(F.substring("text", 1, 12), F.col("cited"))).select("source_id", "segment_index")


QUERIES, ORACLES = query.queries, query.oracles
