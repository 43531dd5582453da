"""Segments, quotes, text functions and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalogue.common import SEG, Register
from colloquy.functions import dates, vectors
from colloquy.functions import text as tx
from colloquy.operators import segments
from colloquy.operators.grouped import chunk_segments
from colloquy.sources.tables import segments as read_segments
from colloquy.sources.tables import table

query = Register()


@query(f"""with {SEG} select source_id, segment_index, cast(source_id as varchar) || '::seg' || lpad(cast(segment_index as varchar), 4, '0') as segment_id, speaker, text,
char_start, char_start + length(text) as char_end from seg""")
def segment_offsets(spark, sf_dir):
    rows = read_segments(spark, sf_dir)
    return rows.select("source_id", "segment_index", "segment_id", "speaker", "text", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


@query(f"with {SEG} select source_id, source_text from texts")
def source_text(spark, sf_dir):
    return segments.source_texts(read_segments(spark, sf_dir))


#: A quote a segment: from its eighth character on; those of odd turns are changed, so that they are not found.
QUOTES = "quotes as (select source_id, segment_index, case when segment_index % 2 = 0 then substring(text, 8, 60) else substring(text, 8, 60) || ' ~' end as quote from seg)"


def _quotes(seg):
    part = F.substring("text", 8, 60)
    return seg.select("source_id", "segment_index", F.when(F.col("segment_index") % 2 == 0, part).otherwise(F.concat(part, F.lit(" ~"))).alias("quote"))


@query(f"""with {SEG}, {QUOTES}, n as (select *, trim(quote) as q from quotes)
select source_id, segment_index, (q <> '' and contains(source_text, q)) as quote_verified,
case when q <> '' and contains(source_text, q) then cast(instr(source_text, q) - 1 as bigint) end as char_start,
case when q <> '' and contains(source_text, q) then cast(instr(source_text, q) - 1 + length(q) as bigint) end as char_end from n join texts using (source_id)""")
def quote_locate(spark, sf_dir):
    seg = read_segments(spark, sf_dir)
    told = segments.ground_quotes(_quotes(seg), segments.source_texts(seg))
    return told.select("source_id", "segment_index", "quote_verified", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


@query(f"with {SEG}, {QUOTES} select source_id, segment_index from quotes join texts using (source_id) where trim(quote) <> '' and contains(source_text, trim(quote))")
def quote_containment_join(spark, sf_dir):
    seg = read_segments(spark, sf_dir)
    rows = _quotes(seg).join(segments.source_texts(seg), "source_id")
    return rows.where(tx.verify_quote(F.col("quote"), F.col("source_text"))).select("source_id", "segment_index")


@query(f"""with {SEG}, {QUOTES}, p as (select source_id, segment_index as quote_index, instr(source_text, trim(quote)) - 1 as pos from quotes join texts using (source_id) where trim(quote) <> '' and contains(source_text, trim(quote)))
select p.source_id, quote_index, segment_index as found_index from p join seg on p.source_id = seg.source_id and pos >= char_start and pos < char_start + length(text)""")
def point_in_interval(spark, sf_dir):
    seg = read_segments(spark, sf_dir)
    points = segments.ground_quotes(_quotes(seg), segments.source_texts(seg)).where("quote_verified").select("source_id", F.col("segment_index").alias("quote_index"), "char_start")
    found = segments.point_in_segment(points, seg)
    return found.join(seg.select("segment_id", F.col("segment_index").alias("found_index")), "segment_id").select("source_id", "quote_index", "found_index")


@query(f"""with {SEG}, {QUOTES}, n as (select source_id, segment_index, trim(quote) as q, source_text from quotes join texts using (source_id))
select source_id, segment_index, (select substring(q, 1, k) from range(12, least(length(q), 200) + 1) r(k) where contains(source_text, substring(q, 1, k)) order by k desc limit 1) as longest from n""")
def longest_prefix(spark, sf_dir):
    seg = read_segments(spark, sf_dir)
    rows = _quotes(seg).join(segments.source_texts(seg), "source_id")
    return rows.select("source_id", "segment_index", tx.longest_prefix(F.col("quote"), F.col("source_text")).alias("longest"))


STOP = ", ".join(f"'{w}'" for w in tx.TASK_STOPWORDS)
WORDS = f"list_filter(list_distinct(regexp_extract_all(lower({{}}), '[a-z0-9]+')), lambda x: length(x) > 2 and not list_contains([{STOP}], x))"


@query(f"""with t as (select conv_id, turn, text, lead(text) over (partition by conv_id order by turn) as other from conversations),
w as (select conv_id, turn, {WORDS.format("text")} as a, {WORDS.format("other")} as b from t where other is not null)
select conv_id, turn, round(case when least(len(a), len(b)) < 2 then 0.0 else len(list_intersect(a, b)) / least(len(a), len(b)) end, 6) as similarity from w""")
def token_containment_similarity(spark, sf_dir):
    from pyspark.sql import Window

    other = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", other.alias("other")).where("other is not null")
    words = rows.select("conv_id", "turn", tx.content_words(F.col("text")).alias("a"), tx.content_words(F.col("other")).alias("b"))
    return words.select("conv_id", "turn", F.round(tx.containment(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("""select a.l_orderkey, a.l_linenumber, b.l_linenumber as other, round(case when least(a.e, b.e) - greatest(a.s, b.s) > 0 then (least(a.e, b.e) - greatest(a.s, b.s)) / least(a.e - a.s, b.e - b.s) else 0.0 end, 6) as overlap
from (select l_orderkey, l_linenumber, l_partkey % 50 as s, l_partkey % 50 + cast(l_quantity as bigint) as e from lineitem) a
join (select l_orderkey, l_linenumber, l_partkey % 50 as s, l_partkey % 50 + cast(l_quantity as bigint) as e from lineitem) b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber""")
def span_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).alias("s"), (F.col("l_partkey") % 50 + F.col("l_quantity").cast("long")).alias("e"))
    other = rows.select("l_orderkey", F.col("l_linenumber").alias("other"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    pairs = rows.join(other, "l_orderkey").where("l_linenumber < other")
    return pairs.select("l_orderkey", "l_linenumber", "other", F.round(tx.span_overlap(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")), 6).alias("overlap"))


SPACES = r"'[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'"


@query(f"select conv_id, turn, substring(sha256(lower(trim(regexp_replace(text, {SPACES}))) || '|' || substring(lower(role), 1, 60)), 1, 32) as dedup_key from conversations")
def dedup_key(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.dedup_key(F.col("text"), F.col("role")).alias("dedup_key"))


@query("""select event_id, case when value * 100 >= 0 then lpad(cast(cast(floor(value * 100) as bigint) // 3600 as varchar), 2, '0') || ':' || lpad(cast(cast(floor(value * 100) as bigint) % 3600 // 60 as varchar), 2, '0') || ':' || lpad(cast(cast(floor(value * 100) as bigint) % 60 as varchar), 2, '0') end as clock from events""")
def clock_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dates.format_timestamp(F.col("value") * 100).alias("clock"))


@query("""select event_id, case when event_id % 75 > 59 or event_id % 61 > 59 then null else cast((event_id % 24) * 3600 + (event_id % 75) * 60 + event_id % 61 as double) end as seconds from events""")
def clock_parse(spark, sf_dir):
    n = F.col("event_id")
    clock = F.format_string("%d:%02d:%02d", n % 24, n % 75, n % 61)
    return table(spark, sf_dir, "events").select("event_id", dates.parse_timestamp(clock).alias("seconds"))


#: Phrases, their kind, and the date they stand for in SQL, d being the anchor.
PHRASES = (
    ("UNSPECIFIED", "unspecified", None),
    ("by 2024-13-45 at the latest", "absolute", "'2024-13-45'"),
    ("october fifteenth", "absolute", "case when make_date(year(d), 10, 15) >= d then make_date(year(d), 10, 15) else make_date(year(d) + 1, 10, 15) end"),
    ("the twenty-first of March 2031", "absolute", "case when make_date(year(d), 3, 21) >= d then make_date(year(d), 3, 21) else make_date(year(d) + 1, 3, 21) end"),
    ("Nov 3rd", "absolute", "case when make_date(year(d), 11, 3) >= d then make_date(year(d), 11, 3) else make_date(year(d) + 1, 11, 3) end"),
    ("as soon as possible", "unspecified", None),
    ("next sprint, by tomorrow", "unspecified", None),
    ("tomorrow morning", "relative_resolved", "d + 1"),
    ("by end of the day", "relative_resolved", "d"),
    ("end of next week", "relative_resolved", "cast(date_trunc('week', d) as date) + 11"),
    ("this week", "relative_resolved", "cast(date_trunc('week', d) as date) + 4"),
    ("end of month", "relative_resolved", "last_day(d)"),
    ("in three weeks", "relative_resolved", "d + 21"),
    ("in 2 months", "relative_resolved", "d + 60"),
    ("by Friday", "relative_resolved", "d + cast(case when (5 - dayofweek(d) + 7) % 7 = 0 then 7 else (5 - dayofweek(d) + 7) % 7 end as integer)"),
    ("next Monday", "relative_resolved", "d + 7 + cast(case when (1 - dayofweek(d) + 7) % 7 = 0 then 7 else (1 - dayofweek(d) + 7) % 7 end as integer)"),
    ("when the moon is right", "unspecified", None),
)
_CASES = " ".join(f"when {k} then cast({sql} as varchar)" for k, (_, _, sql) in enumerate(PHRASES) if sql)
_KINDS = " ".join(f"when {k} then '{kind}'" for k, (_, kind, _) in enumerate(PHRASES))


@query(f"""select o_orderkey, case k {_CASES} else 'UNSPECIFIED' end as value, case k {_KINDS} end as date_type
from (select o_orderkey, o_orderkey % {len(PHRASES)} as k, cast(o_orderdate as date) as d from orders)""")
def due_date_rules(spark, sf_dir):
    stated = F.element_at(F.array(*[F.lit(p) for p, _, _ in PHRASES]), (F.col("o_orderkey") % len(PHRASES)).cast("int") + 1)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", stated.alias("stated"), F.to_date("o_orderdate").alias("d"))
    return rows.select("o_orderkey", dates.resolve_due_date(F.col("stated"), F.col("d")).alias("r")).select("o_orderkey", "r.value", "r.date_type")


@query("select doc_id, case when lower(trim(source)) in ('src1', 'src2') then true else regexp_matches(source, '(?i)^(dm|dms|direct|private)[-_]') end as is_dm from documents")
def dm_predicate(spark, sf_dir):
    flag = tx.F.lower(F.trim("source")).isin("src1", "src2")
    return table(spark, sf_dir, "documents").select("doc_id", tx.is_direct_message(F.col("source"), flag).alias("is_dm"))


@query("select c_custkey, case when lower(trim(c_mktsegment)) in ('', 'unspecified', 'none', 'unknown', 'tbd') or c_custkey % 3 = 0 then 'UNSPECIFIED' else trim(c_mktsegment) end as segment from customer")
def abstention_collapse(spark, sf_dir):
    said = F.when(F.col("c_custkey") % 3 == 0, F.lit(" Not stated. ")).otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.collapse_abstention(F.trim(said)).alias("segment"))


@query("select conv_id, turn, case when role = 'user' then 'Ada Example' when role = 'system' then null else 'assistant' end as speaker from conversations")
def speaker_split(spark, sf_dir):
    label = F.when(F.col("role") == "user", F.lit("Ada Example: ")).when(F.col("role") == "system", F.lit("Action Items: ")).otherwise(F.lit("Assistant: "))
    lookup = tx.speaker_lookup(F.array(F.lit("assistant")))
    line = F.concat(label, F.lit("x"), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.split_speaker(line, lookup)["speaker"].alias("speaker"))


@query("select doc_id, cast(greatest(1, length(text) // 4) as integer) as tokens from documents")
def estimated_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k, cast(json_array_length('[' || repeat('1,', cast(event_id % 5 as integer)) || '1]') as bigint) as n from events")
def json_array_lengths(spark, sf_dir):
    n = F.concat(F.lit("["), F.repeat(F.lit("1,"), (F.col("event_id") % 5).cast("int")), F.lit("1]"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.json_array_length(n).cast("long").alias("n"))


@query("select event_id, round(least(30.0, pow(2.0, event_id % 8)), 6) as wait from events")
def retry_backoff(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(vectors.backoff(F.col("event_id") % 8 + 1), 6).alias("wait"))


@query("select event_id, round((event_id % 7) / nullif(event_id % 5, 0), 6) as ratio from events")
def metric_ratio(spark, sf_dir):
    said = F.concat((F.col("event_id") % 7).cast("string"), F.lit("/"), (F.col("event_id") % 5).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.round(vectors.metric_value(said), 6).alias("ratio"))


@query()
def hashing_embedder(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", vectors.hashing_embedder("text").alias("embedding"))


@query(f"""with recursive {SEG},
lines as (select cast(source_id as varchar) as source_id, segment_index, char_start, char_start + length(text) as char_end, '[--:--:--] ' || coalesce(speaker, 'UNSPECIFIED') || ': ' || text as line from seg),
costs as (select *, greatest(1, length(line) // 4) as cost from lines),
sums as (select *, sum(cost) over (partition by source_id order by segment_index) as upto from costs),
src as (select source_id, list(segment_index order by segment_index) as idx, list(char_start order by segment_index) as s, list(char_end order by segment_index) as e,
  list(line order by segment_index) as lines, list_prepend(0, list(upto order by segment_index)) as pre from sums group by source_id),
walk(source_id, k, a, b, carried) as (
  select source_id, 0, 0, greatest(1, len(list_filter(pre, lambda p: p <= 1200)) - 1), 0 from src
  union all
  select source_id, k + 1, nx, greatest(nx + 1, len(list_filter(pre, lambda p: p <= pre[nx + 1] + 1200)) - 1), b - nx
  from (select w.source_id, k, a, b, pre, greatest(a + 1, len(list_filter(pre, lambda p: p < pre[b + 1] - 200))) as nx from walk w join src using (source_id) where b < len(idx)))
select source_id, source_id || '::chunk' || lpad(cast(k as varchar), 3, '0') as chunk_id, k as chunk_index, count(*) over (partition by source_id) as total,
  idx[a + 1] as first_segment_index, idx[b] as last_segment_index, b - a as n_segments, carried as n_overlap, cast(null as varchar) as start_ts, cast(null as varchar) as end_ts,
  s[a + 1] as char_start, e[b] as char_end, array_to_string(lines[a + 1:b], chr(10)) as text, greatest(1, length(array_to_string(lines[a + 1:b], chr(10))) // 4) as estimated_tokens
from walk join src using (source_id)""")
def chunk_windows(spark, sf_dir):
    rows = read_segments(spark, sf_dir).select(F.col("source_id").cast("string").alias("source_id"), F.col("segment_index").cast("int").alias("segment_index"), F.lit(None).cast("string").alias("start_ts"), "speaker", "text", "char_start", "char_end")
    return chunk_segments(rows)


QUERIES, ORACLES = query.queries, query.oracles
