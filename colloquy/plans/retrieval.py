"""Retrieval: BM25, nearest neighbours, rank fusion, neighbour expansion, cited answers.

Question-sized inputs (terms, query vectors, hits) are small by nature: a question's terms and at most
``limit`` hits.  Corpus-sized steps are one pass with partial aggregation.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions.porter import porter_tokens, stem, tokens
from colloquy.functions.text import search_text, verify_quote
from colloquy.functions.vectors import dot, hashing_embedder
from colloquy.operators.segments import neighbours

K1, B, FLOOR = 1.2, 0.75, 1e-6
RRF_K, TOP_K, WINDOW, CAP, FETCH = 60, 8, 1, 24, 3

# Words that a keyword query leaves out.
QUERY_STOPWORDS = (
    "a an and are as at be been by did do does for from had has have how i in is it its "
    "of on or so than that the their them there these this to was we were what when where "
    "which who whom why will with you your our us"
).split()


def query_words(question: str) -> list[str]:
    """Words of a question without stopwords and single letters; if none is left, its first six words."""
    words = re.findall(r"[a-z0-9']+", question.lower())
    return [w for w in words if len(w) > 1 and w not in QUERY_STOPWORDS] or words[:6]


def query_phrases(question: str) -> list[list[str]]:
    """Stemmed tokens of each query word; a word with an apostrophe is a phrase."""
    return [p for p in ([stem(t) for t in tokens(w)] if "'" in w else tokens(w) for w in query_words(question)) if p]


def plain_tokens(x: Column) -> Column:
    """ASCII words, not stemmed."""
    return F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)"), F.lit(1))


def _occurrences(terms: Column, phrase: list[str]) -> Column:
    """How often a phrase occurs whose last token may be a beginning."""
    *head, last = phrase
    if not head:
        return F.size(F.filter(terms, lambda t: F.startswith(t, F.lit(last))))
    at = F.sequence(F.lit(1), F.size(terms) - len(head))

    def whole(i: Column) -> Column:
        out = F.startswith(F.element_at(terms, i + len(head)), F.lit(last))
        for k, word in enumerate(head):
            out = out & (F.element_at(terms, i + k) == word)
        return out

    return F.when(F.size(terms) > len(head), F.size(F.filter(at, whole))).otherwise(0)


def bm25(docs: DataFrame, phrases: list[list[str]], stemmed: bool = True, scope: Column | None = None, match_all: bool = False) -> DataFrame:
    """``docs`` (id, text, ...) that match, with keyword_score.

    Query words match as beginnings of (stemmed) tokens.  Statistics are of the whole table; a scope
    narrows the rows afterwards.  Documents are scored in place: only a row of statistics is aggregated.
    """
    terms = porter_tokens("text") if stemmed else plain_tokens(F.col("text"))
    counts = [_occurrences(F.col("_terms"), p).cast("double").alias(f"_f{k}") for k, p in enumerate(phrases)]
    rows = docs.withColumn("_terms", terms).select(*docs.columns, F.size("_terms").cast("double").alias("_dl"), *counts)
    if not phrases:
        return docs.limit(0).withColumn("keyword_score", F.lit(0.0))
    # one row of statistics; as numbers, they need no join
    stats = rows.agg(F.count("*").cast("double").alias("n"), F.avg("_dl").alias("avg"), *[F.count_if(F.col(f"_f{k}") > 0).cast("double").alias(f"n{k}") for k in range(len(phrases))]).first()
    score = F.lit(0.0)
    for k in range(len(phrases)):
        f, n = F.col(f"_f{k}"), stats[f"n{k}"]
        idf = math.log((stats["n"] - n + 0.5) / (n + 0.5))
        weight = idf if idf > 0 else FLOOR
        score = score + F.when(f > 0, weight * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_dl") / (stats["avg"] or 1.0)))).otherwise(0.0)
    hits = [F.col(f"_f{k}") > 0 for k in range(len(phrases))]
    some = hits[0]
    for h in hits[1:]:
        some = (some & h) if match_all else (some | h)
    out = rows.where(some).withColumn("keyword_score", score)
    if scope is not None:
        out = out.where(scope)
    return out.select(*docs.columns, "keyword_score")


def with_rank(df: DataFrame, score: str, rank: str, limit: int, *ties: Column) -> DataFrame:
    """The best ``limit`` rows, ranked from 1: at most ``limit`` rows meet in one task."""
    top = df.orderBy(F.col(score).desc(), *ties).limit(limit)
    return top.withColumn(rank, F.row_number().over(Window.orderBy(F.col(score).desc(), *ties)))


def keyword_search(segments: DataFrame, extractions: DataFrame, question: str, limit: int = TOP_K, scope=None, stemmed: bool = True, sources: DataFrame | None = None) -> DataFrame:
    """Ranked hits (ref_type, ref_id, source_id, text, keyword_score, keyword_rank) of both corpora.

    Each corpus keeps its own statistics; on equal scores segments come first.  With ``sources``, segments of sources that
    do not consent, and hits of unknown ones, are left out.
    """
    phrases = query_phrases(question) if stemmed else [[w] for w in query_words(question)]
    inside = F.col("source_id").isin(list(scope)) if scope else None
    a = bm25(segments.select(F.lit("segment").alias("ref_type"), F.col("segment_id").alias("ref_id"), "source_id", "text"), phrases, stemmed, inside)
    items = extractions.withColumn("text", search_text(F.col("payload"), F.col("verbatim_quote")))
    visible = F.col("status") == "approved"
    b = bm25(items.select(F.lit("extraction").alias("ref_type"), F.col("id").alias("ref_id"), "source_id", "text", "status"), phrases, stemmed, visible & inside if inside is not None else visible)
    both = a.unionByName(b.drop("status"))
    if sources is not None:
        agreed = F.col("consent_flag").eqNullSafe(True)
        both = both.join(sources.select("source_id", agreed.alias("_agreed")), "source_id").where((F.col("ref_type") != "segment") | F.col("_agreed")).drop("_agreed")
    return with_rank(both, "keyword_score", "keyword_rank", limit, F.col("ref_type").desc(), F.col("ref_id"))


def dense_search(vectors: DataFrame, query: list[float], limit: int = TOP_K, scope=None) -> DataFrame:
    """The nearest vectors (ref_type, ref_id, source_id, embedding) by inner product: filter, score, top-k."""
    rows = vectors.where(F.col("source_id").isin(list(scope))) if scope else vectors
    scored = rows.withColumn("dense_score", dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))).drop("embedding")
    return with_rank(scored, "dense_score", "dense_rank", limit, F.col("ref_type").desc(), F.col("ref_id"))


def hydrate(hits: DataFrame, segments: DataFrame, extractions: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits (ref_type, ref_id, ...) as rows that can be cited: text, speaker, timestamp, char_start, char_end, title.

    A reference to no segment, to no approved extraction, or to no source is dropped.
    """
    seg = segments.select(F.lit("segment").alias("ref_type"), F.col("segment_id").alias("ref_id"), "source_id", "text", "speaker", F.col("start_ts").alias("timestamp"), "char_start", "char_end")
    ext = extractions.where("status = 'approved'").select(F.lit("extraction").alias("ref_type"), F.col("id").alias("ref_id"), "source_id", F.col("verbatim_quote").alias("text"), "speaker", "timestamp", "char_start", "char_end")
    own = [c for c in hits.columns if c not in ("source_id", "text")]
    # hits are at most as many as a question asks for; the corpus is not moved
    return seg.unionByName(ext).join(F.broadcast(hits.select(*own)), ["ref_type", "ref_id"]).join(sources.select("source_id", "title"), "source_id")


def reciprocal_rank_fusion(keyword: DataFrame, dense: DataFrame, limit: int = TOP_K, k: int = RRF_K) -> DataFrame:
    """Both rankings by the sum of 1 / (k + rank); ties in order of first appearance, keyword list first."""
    null = F.lit(None)
    a = keyword.select("ref_type", "ref_id", "source_id", "keyword_rank", "keyword_score", null.cast("int").alias("dense_rank"), null.cast("double").alias("dense_score"))
    b = dense.select("ref_type", "ref_id", "source_id", null.cast("int").alias("keyword_rank"), null.cast("double").alias("keyword_score"), "dense_rank", "dense_score")
    kept = [F.max(c).alias(c) for c in ("keyword_rank", "keyword_score", "dense_rank", "dense_score")]
    merged = a.unionByName(b).groupBy("ref_type", "ref_id", "source_id").agg(*kept)
    part = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    scored = merged.withColumn("score", part("keyword_rank") + part("dense_rank"))
    return with_rank(scored, "score", "rank", limit, F.col("keyword_rank").asc_nulls_last(), F.col("dense_rank").asc_nulls_last()).withColumn("found_by", found_by())


def found_by() -> Column:
    return F.when(F.col("keyword_rank").isNotNull() & F.col("dense_rank").isNotNull(), "both").when(F.col("keyword_rank").isNotNull(), "keyword").otherwise("dense")


def expand_with_neighbours(hits: DataFrame, segments: DataFrame, window: int = WINDOW, cap: int = CAP) -> DataFrame:
    """Hits (ref_type, ref_id, source_id, rank) and, after them, the segments next to segment hits; ``cap`` rows."""
    placed = hits.where("ref_type = 'segment'").join(segments.select(F.col("segment_id").alias("ref_id"), "segment_index"), "ref_id")
    near = neighbours(placed.select("source_id", "segment_index", "rank"), segments, window)
    first = hits.select("ref_type", "ref_id", "source_id", F.lit(0).alias("_part"), F.col("rank").alias("_hit"), F.lit(0).alias("_at"))
    more = near.select(F.lit("segment").alias("ref_type"), F.col("segment_id").alias("ref_id"), "source_id", F.lit(1).alias("_part"), F.col("rank").alias("_hit"), F.col("segment_index").alias("_at"))
    order = ["_part", "_hit", "_at"]
    top = first.unionByName(more).orderBy(*order).limit(cap)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order))).withColumn("is_neighbour", F.col("_part") == 1).drop(*order)


def search(segments: DataFrame, extractions: DataFrame, vectors: DataFrame, question: str, query: list[float], mode: str = "hybrid", limit: int = TOP_K, window: int = WINDOW, scope=None) -> DataFrame:
    """Hits of a question by keyword, dense or hybrid search, with neighbours."""
    if mode == "keyword":
        hits = keyword_search(segments, extractions, question, limit, scope).withColumn("rank", F.col("keyword_rank"))
    elif mode == "dense":
        hits = dense_search(vectors, query, limit, scope).withColumn("rank", F.col("dense_rank"))
    elif mode == "hybrid":
        hits = reciprocal_rank_fusion(keyword_search(segments, extractions, question, FETCH * limit, scope), dense_search(vectors, query, FETCH * limit, scope), limit)
    else:
        raise ValueError(f"mode {mode!r} is none of keyword, dense, hybrid")
    return expand_with_neighbours(hits, segments, window)


def verified_claims(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """Claims (source_number, quote, text) whose quote is in the very source they cite (position, text)."""
    cited = hits.select(F.col("position").alias("source_number"), F.col("text").alias("_cited"))
    return claims.join(F.broadcast(cited), "source_number").where(verify_quote(F.col("quote"), F.col("_cited"))).drop("_cited")


def answer(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: found (some claim holds), kept and dropped counts."""
    cited = hits.select(F.col("position").alias("source_number"), F.col("text").alias("_cited"))
    holds = F.coalesce(verify_quote(F.col("quote"), F.col("_cited")), F.lit(False))
    judged = claims.join(F.broadcast(cited), "source_number", "left").select(holds.alias("holds"))
    return judged.agg((F.count_if("holds") > 0).alias("found"), F.count_if("holds").alias("kept"), F.count_if(~F.col("holds")).alias("dropped"))


def chat_search(messages: DataFrame, query: str, limit: int = 10, scope=None) -> DataFrame:
    """Channel messages with all words of a query; one that is no plain list of words is an error."""
    if not re.fullmatch(r"[\w\s*]+", query):
        raise ValueError("the query may hold words only")
    rows = messages.select(F.col("id").alias("ref_id"), "channel", "text")
    inside = F.col("channel").isin(list(scope)) if scope else None
    found = bm25(rows, [[t] for t in tokens(query.replace("*", " "))], True, inside, match_all=True)
    return with_rank(found, "keyword_score", "keyword_rank", limit, F.col("ref_id"))


def build_postings(docs: DataFrame, path: str, stemmed: bool = True) -> None:
    """An inverted index of ``docs`` (id, text): token, id, positions and length of the text, sorted by token.

    Texts are tokenised here and not again by a search, which reads the row groups of its tokens.
    """
    terms = porter_tokens("text") if stemmed else plain_tokens(F.col("text"))
    rows = docs.select("id", terms.alias("terms")).select("id", F.size("terms").alias("dl"), F.posexplode_outer("terms").alias("position", "token"))
    postings = rows.groupBy(F.coalesce("token", F.lit("")).alias("token"), "id", "dl").agg(F.array_compact(F.array_sort(F.collect_list("position"))).alias("positions"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ids are part of the order, so that a very frequent token may go over partitions
    postings.repartitionByRange(n, "token", "id").sortWithinPartitions("token", "id").write.mode("overwrite").parquet(path)
    lengths = postings.select("id", "dl").distinct()
    lengths.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avg")).write.mode("overwrite").parquet(f"{path}_stats")


def search_postings(spark: SparkSession, path: str, phrases: list[list[str]]) -> DataFrame:
    """id, keyword_score of the texts that match: what bm25() tells, from an inverted index."""
    postings = spark.read.parquet(path)
    stats = spark.read.parquet(f"{path}_stats").first()
    found = None
    for k, phrase in enumerate(phrases):
        starts = None
        for at, word in enumerate(phrase):
            same = F.col("token").startswith(word) & (F.col("token") != "") if at == len(phrase) - 1 else F.col("token") == word
            rows = postings.where(same).select("id", "dl", F.explode("positions").alias("start")).withColumn("start", F.col("start") - at)
            starts = rows if starts is None else starts.join(rows.select("id", "start").distinct(), ["id", "start"], "left_semi")
        counts = starts.groupBy("id", "dl").agg(F.count("*").cast("double").alias("f")).withColumn("k", F.lit(k))
        found = counts if found is None else found.unionByName(counts)
    if found is None:
        return postings.select("id").limit(0).withColumn("keyword_score", F.lit(0.0))
    seen = found.groupBy("k").agg(F.count("*").cast("double").alias("seen"))
    idf = F.log((stats["n"] - F.col("seen") + 0.5) / (F.col("seen") + 0.5))
    weight = F.when(idf > 0, idf).otherwise(FLOOR)
    part = weight * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / (stats["avg"] or 1.0)))
    # one row a phrase
    return found.join(F.broadcast(seen), "k").groupBy("id").agg(F.sum(part).alias("keyword_score"))


def indexable(segments: DataFrame, sources: DataFrame, extractions: DataFrame) -> DataFrame:
    """Texts to be embedded: segments of consenting sources, approved extractions."""
    agreed = sources.where(F.col("consent_flag").eqNullSafe(True)).select("source_id")
    a = segments.join(agreed, "source_id", "left_semi").select(F.lit("segment").alias("ref_type"), F.col("segment_id").alias("ref_id"), "source_id", "text")
    b = extractions.where("status = 'approved'").select(F.lit("extraction").alias("ref_type"), F.col("id").alias("ref_id"), "source_id", search_text(F.col("payload"), F.col("verbatim_quote")).alias("text"))
    return a.unionByName(b)


#: From a column of texts to a column of vectors.
Embedder = Callable[[str], Column]


def build_index(texts: DataFrame, path: str, embedder: Embedder = hashing_embedder) -> None:
    """Vectors of texts by any embedder, written with their hash, so that staleness is an anti-join."""
    hashed = F.sha2(F.col("text").cast("binary"), 256).alias("text_hash")
    texts.select("ref_type", "ref_id", "source_id", embedder("text").alias("embedding"), hashed, F.current_timestamp().alias("built_at")).write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    index = spark.read.parquet(path)
    if expected is not None and (n := index.count()) != expected:
        raise ValueError(f"the index has {n} vectors, {expected} are mapped")
    return index


def stale_vectors(texts: DataFrame, index: DataFrame) -> DataFrame:
    hashed = texts.withColumn("text_hash", F.sha2(F.col("text").cast("binary"), 256))
    return hashed.join(index.select("ref_type", "ref_id", "text_hash"), ["ref_type", "ref_id", "text_hash"], "left_anti")


def index_stats(index: DataFrame) -> DataFrame:
    return index.groupBy("ref_type").agg(F.count("*").alias("n"), F.max("built_at").alias("built_at"))
