"""Parsers, sinks read back, searches that can be cited, listings and metrics."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from colloquy.catalogue.common import ITEMS, SEG, Register, items
from colloquy.catalogue.retrieval import QUESTION, SEGTEXT, TERMS, _bm25_sql
from colloquy.functions import dates, vectors
from colloquy.functions import text as tx
from colloquy.operators import evaluation, followups, relational, review, rollups, segments, tracker
from colloquy.plans import agent, retrieval
from colloquy.schemas import DEFECTS
from colloquy.sources import files, sinks
from colloquy.sources.scratch import scratch_path
from colloquy.sources.tables import segments as read_segments
from colloquy.sources.tables import table

query = Register()

SAID = r"""said as (select conv_id as source_id, turn, role, trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) as text,
  lpad(cast(turn * 7 // 3600 as varchar), 2, '0') || ':' || lpad(cast(turn * 7 // 60 % 60 as varchar), 2, '0') || ':' || lpad(cast(turn * 7 % 60 as varchar), 2, '0') as clock,
  cast(row_number() over (partition by conv_id order by turn) as integer) as n from conversations)"""


def _said(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("source_id"), "turn", "role", tx.normalise_text(F.col("text")).alias("text"), dates.format_timestamp(F.col("turn") * 7).alias("clock"))


def _as_files(said, suffix: str, entry, between: str, head: str = "", tail: str = ""):
    """A file's text for each conversation, made of an entry for each turn."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", entry.alias("e")))), lambda x: x["e"])
    rows = said.groupBy("source_id").agg(F.concat(F.lit(head), F.array_join(ordered, between), F.lit(tail)).alias("text"), F.array_sort(F.collect_set("role")).alias("participants"))
    return rows.select("source_id", F.concat(F.col("source_id").cast("string"), F.lit(f".{suffix}")).alias("path"), "text", "participants", F.array().cast(DEFECTS).alias("defects"))


def _segments_of(parsed):
    rows = parsed.select("source_id", "format", F.size("defects").alias("n_defects"), F.explode("segments").alias("s"))
    return rows.select("source_id", "format", "n_defects", "s.speaker", "s.start_ts", F.col("s.start_seconds").alias("start_seconds"), "s.text", "s.line_number")


_PARSED = "select source_id, '{}' as format, 0 as n_defects, role as speaker, clock as start_ts, cast(turn * 7 as double) as start_seconds, text, cast({} as integer) as line_number from said where text <> ''"


@query(f"with {SAID} {_PARSED.format('txt', '2 * n - 1')}")
def txt_transcripts(spark, sf_dir):
    line = F.concat(F.lit("["), "clock", F.lit("] "), "role", F.lit(": "), "text")
    return _segments_of(files.parse_files(_as_files(_said(spark, sf_dir), "txt", line, "\n\n")))


@query(f"with {SAID} {_PARSED.format('vtt', '4 * n')}")
def vtt_transcripts(spark, sf_dir):
    cue = F.concat(F.col("turn").cast("string"), F.lit("\n"), "clock", F.lit(".000 --> "), "clock", F.lit(".900\n<v "), "role", F.lit(">"), "text")
    return _segments_of(files.parse_files(_as_files(_said(spark, sf_dir), "vtt", cue, "\n\n", "WEBVTT\n\n")))


@query(f"with {SAID} {_PARSED.format('json', 'n')}")
def json_transcripts(spark, sf_dir):
    entry = F.to_json(F.struct(F.col("role").alias("participant"), (F.col("turn") * 7).alias("ts"), F.col("text").alias("utterance")))
    return _segments_of(files.parse_files(_as_files(_said(spark, sf_dir), "json", entry, ",", '{"utterances": [', "]}")))


def _chats(spark, sf_dir):
    channel = F.when(F.col("turn") % 4 == 3, "dm-ada").otherwise(F.concat(F.lit("room"), (F.col("turn") % 3).cast("string")))
    entry = F.to_json(F.struct(F.col("turn").alias("msg_id"), channel.alias("room"), F.col("role").alias("user"), F.col("clock").alias("sent_at"), F.col("text").alias("body"), (F.col("turn") % 5 == 4).alias("is_dm")))
    return files.parse_chat_files(_as_files(_said(spark, sf_dir), "json", entry, ",", '{"messages": [', "]}"))


@query(f"""with {SAID} select source_id, cast(turn as varchar) as id, 'room' || cast(turn % 3 as varchar) as channel, role as author, clock as ts, text from said where turn % 4 <> 3 and turn % 5 <> 4 and text <> ''""")
def chat_messages(spark, sf_dir):
    return _chats(spark, sf_dir).select("source_id", F.explode("messages").alias("m")).select("source_id", "m.id", "m.channel", "m.author", "m.ts", "m.text")


@query(f"""with {SAID} select source_id, cast(count(*) filter (turn % 4 = 3 or turn % 5 = 4) as integer) as direct_messages_excluded, count(*) filter (turn % 4 <> 3 and turn % 5 <> 4) as stored from said group by 1""")
def chat_reports(spark, sf_dir):
    return _chats(spark, sf_dir).select("source_id", "direct_messages_excluded", F.size("messages").cast("long").alias("stored"))


@query(f"""with {SAID} select source_id, sha256(string_agg('[' || clock || '] ' || role || ': ' || text, chr(10) order by turn) || chr(10)) as content_hash,
cast(strlen(string_agg('[' || clock || '] ' || role || ': ' || text, chr(10) order by turn)) + 1 as integer) as bytes_read, 0 as defects, 'txt' as format from said group by 1""")
def files_read_back(spark, sf_dir):
    """Files of lines, written to the shared folder and read strictly."""
    path = scratch_path(spark, "lines")
    line = F.concat(F.lit("["), "clock", F.lit("] "), "role", F.lit(": "), "text").alias("line")
    # one partition writes the file of a conversation
    _said(spark, sf_dir).select("source_id", "turn", line).repartition("source_id").sortWithinPartitions("source_id", "turn").select("source_id", "line").write.partitionBy("source_id").text(path)
    read = files.read_files(spark, f"{path}/*/*.txt")
    own = F.regexp_extract("path", r"source_id=(\d+)/", 1).cast("long").alias("source_id")
    return read.select(own, "content_hash", F.col("bytes_read").cast("int").alias("bytes_read"), F.size("defects").alias("defects"), files.detect_format(F.col("path"), F.col("text")).alias("format"))


# --- search that can be cited -----------------------------------------------------------------


def _extractions(spark, sf_dir):
    own = items(spark, sf_dir)
    none = F.lit(None).cast("string")
    return own.select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("id"), F.col("scope_key").alias("source_id"), "extraction_type", "status", "payload", F.left("text", F.lit(400)).alias("verbatim_quote"), none.alias("speaker"), none.alias("timestamp"), F.lit(0).alias("char_start"), F.lit(400).alias("char_end"))


#: Extractions as SQL: their words are their payload's values and the quote.
EXT = f"""{ITEMS}, ext as (select 'x' || cast(id as varchar) as id, scope_key as source_id, status, substring(text, 1, 400) as quote,
  case kind when 'risk' then severity when 'signal' then classification else owner || ' ' || due_date end || ' ' || substring(text, 1, 400) as text from items)"""


def _segs(spark, sf_dir):
    return read_segments(spark, sf_dir).withColumns({"source_id": F.concat(F.lit("c"), F.col("source_id").cast("string")), "start_ts": dates.format_timestamp(F.col("segment_index") * 7)})


def _sources(spark, sf_dir):
    n = F.col("conv_id")
    talks = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), n.cast("string")).alias("source_id"), F.concat(F.lit("Talk "), n.cast("string")).alias("title"), (n % 7 != 3).alias("consent_flag")).distinct()
    others = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("source").alias("title"), F.lit(True).alias("consent_flag")).distinct()
    return talks.unionByName(others)


@query(f"with {EXT} select id, text from ext")
def search_text_projection(spark, sf_dir):
    return _extractions(spark, sf_dir).select("id", tx.search_text(F.col("payload"), F.col("verbatim_quote")).alias("text"))


@query(f"""with {SEGTEXT}, {EXT} select 'segment' as ref_type, sid as ref_id, 'c' || cast(source_id as varchar) as source_id, text from st0 where source_id % 7 <> 3
union all select 'extraction', id, source_id, text from ext where status = 'approved'""")
def indexable_texts(spark, sf_dir):
    return retrieval.indexable(_segs(spark, sf_dir), _sources(spark, sf_dir), _extractions(spark, sf_dir))


def _marked(sql: str, mark: str) -> str:
    return re.sub(r"\b(tok|cnt|st|kw)\b", rf"\1_{mark}", sql)


@query(f"""with {SEGTEXT}, {EXT}, {_marked(_bm25_sql('st0', 'sid'), 'a')}, {_marked(_bm25_sql('ext', 'id'), 'b')},
hits as (select 'segment' as ref_type, kw_a.id as ref_id, 'c' || cast(source_id as varchar) as source_id, 'Talk ' || cast(source_id as varchar) as title, st0.text, keyword_score from kw_a join st0 on st0.sid = kw_a.id where source_id % 7 <> 3
  union all select 'extraction', ext.id, source_id, source_id, quote, keyword_score from kw_b join ext on ext.id = kw_b.id where status = 'approved')
select ref_type, ref_id, source_id, title, text, round(keyword_score, 6) as keyword_score, cast(row_number() over (order by keyword_score desc, ref_type desc, ref_id) as integer) as keyword_rank from hits order by keyword_rank limit 12""")
def cited_hits(spark, sf_dir):
    """Two keyword lists over segments and approved extractions, joined to their sources and made citable."""
    seg, ext, sources = _segs(spark, sf_dir), _extractions(spark, sf_dir), _sources(spark, sf_dir)
    hits = retrieval.keyword_search(seg, ext, QUESTION, 12, stemmed=False, sources=sources)
    return retrieval.hydrate(hits, seg, ext, sources).select("ref_type", "ref_id", "source_id", "title", "text", F.round("keyword_score", 6).alias("keyword_score"), "keyword_rank")


@query(f"with {_bm25_sql('documents', 'doc_id')} select id, round(keyword_score, 6) as keyword_score from kw")
def inverted_index(spark, sf_dir):
    """Every match of a question, scored from written postings."""
    path = scratch_path(spark, "postings")
    retrieval.build_postings(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), path, stemmed=False)
    return retrieval.search_postings(spark, path, [[w] for w in TERMS]).select("id", F.round("keyword_score", 6).alias("keyword_score"))


@query()
def hybrid_search(spark, sf_dir):
    """Both halves over whole tables: keyword lists and vectors of segments and approved extractions, fused, with neighbours."""
    seg, ext = _segs(spark, sf_dir), _extractions(spark, sf_dir)
    texts = retrieval.indexable(seg, _sources(spark, sf_dir), ext)
    path = scratch_path(spark, "vectors")
    retrieval.build_index(texts, path)
    asked = [float(x) for x in vectors.hash_embedding(QUESTION)]
    return retrieval.search(seg, ext, retrieval.load_index(spark, path), QUESTION, asked)


@query(f"""with {SEGTEXT}, {_bm25_sql('st0', 'sid')},
hits as (select sid, text, row_number() over (order by keyword_score desc, sid) as position from kw join st0 on st0.sid = kw.id order by position limit 8),
claims as (select c.turn % 10 as source_number, trim(substring(c.text, 1, 12)) as quote from conversations c union all select position, substring(text, 5, 30) from hits)
select count(*) filter (ok) > 0 as found, count(*) filter (ok) as kept, count(*) filter (not ok) as dropped
from (select coalesce(trim(regexp_replace(quote, '\\s+', ' ', 'g')) <> '' and contains(text, trim(regexp_replace(quote, '\\s+', ' ', 'g'))), false) as ok from claims left join hits on source_number = position)""")
def answered_question(spark, sf_dir):
    """Claims of every turn, and of the passages themselves, against the passages that a question finds."""
    seg, ext = _segs(spark, sf_dir).drop("source_id"), _extractions(spark, sf_dir).limit(0)
    seg = seg.withColumn("source_id", F.lit("all"))
    hits = retrieval.keyword_search(seg, ext, QUESTION, 8, stemmed=False).withColumn("position", F.col("keyword_rank"))
    turns = table(spark, sf_dir, "conversations").select((F.col("turn") % 10).cast("int").alias("source_number"), F.left("text", F.lit(12)).alias("quote"))
    return retrieval.answer(turns.unionByName(hits.select(F.col("position").alias("source_number"), F.substring("text", 5, 30).alias("quote"))), hits)


# --- sinks, read back --------------------------------------------------------------------------


@query("""select doc_id, source, case when source in ('src1', 'src2') then 'new' else 'old' end as state from documents where source not in ('src1', 'src2', 'src3') or (source in ('src1', 'src2') and doc_id % 2 = 0)""")
def replaced_sources(spark, sf_dir):
    """Three sources replaced, of which one has no rows any more."""
    path = scratch_path(spark, "by_source")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    rows.withColumn("state", F.lit("old")).write.parquet(path)
    gone = rows.where("source in ('src1', 'src2', 'src3')").select("source").distinct()
    sinks.replace_sources(rows.where("source in ('src1', 'src2') and doc_id % 2 = 0").withColumn("state", F.lit("new")), path, gone, "source")
    return spark.read.parquet(path)


@query("select event_type as source_id, count(*) as events, 1 as record_version from events group by 1 union all select event_type, count(*), 2 from events where event_type <> 'view' group by 1")
def versioned_records(spark, sf_dir):
    path = scratch_path(spark, "records")
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source_id")).agg(F.count("*").alias("events"))
    sinks.write_versioned(rows, path)
    sinks.write_versioned(rows.where("source_id <> 'view'"), path)
    read = spark.read.json(path)
    return read.select(F.col("source_id").cast("string").alias("source_id"), F.get_json_object("record", "$.events").cast("long").alias("events"), F.col("record_version").cast("int").alias("record_version"))


@query("select event_id, event_type from events order by event_id desc limit 25")
def log_tail(spark, sf_dir):
    path = scratch_path(spark, "log")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    for part in range(2):
        sinks.append_log(rows.where(F.col("event_id") % 2 == part), path)
    return files.read_log(spark, path, "event_id long, event_type string", 25, "event_id")


@query("select r_name || '.md' as key, '# ' || r_name as content from region")
def stored_documents(spark, sf_dir):
    root = scratch_path(spark, "documents")
    for r in table(spark, sf_dir, "region").select("r_name").collect():
        sinks.write_document(spark, root, f"notes/{r['r_name'].replace(' ', '_')}.md", f"# {r['r_name']}")
    read = files.read_documents(spark, root, "notes/")
    return read.select(F.translate(F.regexp_replace("key", "^notes/", ""), "_", " ").alias("key"), "content")


@query("select 'MOCK-' || cast(o_orderkey as varchar) as external_ref, o_orderkey % 3 = 0 as seeded from orders where o_orderkey % 3 <> 1 union all select 'OLD-' || cast(c_custkey as varchar), true from customer where c_custkey % 50 = 0")
def seeded_backlog(spark, sf_dir):
    """A backlog seeded again: rows seeded before go, written ones stay, and one written before stays once."""
    n = F.col("o_orderkey")
    written = table(spark, sf_dir, "orders").where(n % 3 != 1).select(F.concat(F.lit("MOCK-"), n.cast("string")).alias("external_ref"), n.cast("string").alias("source_ref"), F.lit(False).alias("seeded"))
    before = written.limit(0).unionByName(written.select(F.concat(F.lit("GONE-"), "external_ref").alias("external_ref"), F.lit(None).cast("string").alias("source_ref"), F.lit(True).alias("seeded")))
    c = F.col("c_custkey")
    backlog = table(spark, sf_dir, "customer").where(c % 50 == 0).select(F.concat(F.lit("OLD-"), c.cast("string")).alias("external_ref"))
    told = tracker.seed_backlog(written.unionByName(before), backlog)
    return told.select("external_ref", F.coalesce(F.when(F.col("source_ref").isNotNull(), F.col("source_ref").cast("long") % 3 == 0), F.col("seeded")).alias("seeded"))


@query("select cast(o_orderkey as varchar) as external_ref, o_orderkey % 4 = 0 and o_orderkey % 5 <> 0 as taken_back from orders")
def compensated_items(spark, sf_dir):
    n = F.col("o_orderkey")
    made = table(spark, sf_dir, "orders").select(n.cast("string").alias("external_ref"), F.when(n % 4 == 0, n).alias("source_ref"))
    writes = table(spark, sf_dir, "orders").where(n % 5 == 0).select(n.cast("string").alias("external_ref"))
    kept, lost = tracker.undo_unrecorded(made, writes)
    return kept.select("external_ref", F.lit(False).alias("taken_back")).unionByName(lost.select("external_ref", F.lit(True).alias("taken_back")))


#: Requests for drafts made of events: a draft a user.
_REQUESTS = """rq as (select user_id as draft_id, event_id as seq, case when event_id % 4 = 0 then 'send' else 'edit' end as kind,
  case when event_id % 7 = 0 then ' ' when event_id % 11 = 0 then 'Scheduler' else 'Ada' end as person, 'text ' || cast(event_id as varchar) as body from events),
ok as (select *, kind = 'send' and person = 'Ada' as sends from rq where person <> ' ' and (kind = 'edit' or person = 'Ada')),
ends as (select draft_id, min(seq) filter (sends) as sent_at from ok group by 1)"""


@query(f"""with {_REQUESTS}, told as (select draft_id, arg_max(body, seq) filter (kind = 'edit' and (sent_at is null or seq < sent_at)) as edited_body, max(sent_at) as sent_at from ok join ends using (draft_id) group by 1)
select cast(d.user_id as varchar) as draft_id, case when sent_at is not null then 'sent' when edited_body is not null then 'edited' else 'draft' end as status, edited_body, case when sent_at is not null then 'Ada' end as sent_by,
coalesce(edited_body, 'drafted') as text_to_send from (select distinct user_id from events) d left join told on told.draft_id = d.user_id""")
def followup_requests(spark, sf_dir):
    """Edits and sendings of drafts, of which some may not happen."""
    n = F.col("event_id")
    ev = table(spark, sf_dir, "events")
    requests = ev.select(
        F.col("user_id").cast("string").alias("draft_id"), n.alias("seq"), F.when(n % 4 == 0, "send").otherwise("edit").alias("kind"),
        F.when(n % 7 == 0, " ").when(n % 11 == 0, "Scheduler").otherwise("Ada").alias("person"), F.concat(F.lit("text "), n.cast("string")).alias("body"), F.lit("general").alias("channel"),
    )
    drafts = ev.select(F.col("user_id").cast("string").alias("draft_id")).distinct().withColumns({"body": F.lit("drafted"), "status": F.lit("draft")})
    told = followups.apply_requests(drafts, requests)
    return told.select("draft_id", "status", "edited_body", "sent_by", followups.text_to_send().alias("text_to_send"))


# --- listings and projections ------------------------------------------------------------------


@query("select user_id, event_id, cast(row_number() over (partition by user_id order by ts, event_id) as integer) as position from events")
def review_history(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.col("ts").alias("created_at"))
    return relational.ranked(rows, ["user_id"], *review.history_order(), name="position").select("user_id", F.col("seq").alias("event_id"), "position")


@query("select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_orderdate, cast(o_orderkey as varchar)) as integer) as position from orders")
def tracker_listing(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").cast("string").alias("external_ref"))
    return relational.ranked(rows, ["o_custkey"], *tracker.tracker_order(), name="position").select("o_custkey", F.col("external_ref").cast("long").alias("o_orderkey"), "position")


@query("""select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by l, v desc) as integer) as record_position, cast(row_number() over (partition by o_custkey order by o_orderdate desc, v desc, l) as integer) as draft_position
from (select *, cast(o_orderkey % 5 as varchar) as l, o_orderkey as v from orders)""")
def record_listings(spark, sf_dir):
    n = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", n, F.col("o_orderdate").alias("generated_at"), (n % 5).cast("string").alias("source_id"), n.alias("record_version"), n.alias("draft_version"))
    rows = relational.ranked(rows, ["o_custkey"], *rollups.record_order(), name="record_position")
    return relational.ranked(rows, ["o_custkey"], *followups.draft_order(), name="draft_position").select("o_custkey", "o_orderkey", "record_position", "draft_position")


@query("select conv_id, turn from conversations where turn between 1 and 3")
def transcript_slice(spark, sf_dir):
    return agent.slice_rows(table(spark, sf_dir, "conversations"), "turn", 1, 3).select("conv_id", "turn")


@query("select doc_id, case when length(text) > 4000 then substring(text, 1, 4000) || chr(10) || '(' || cast(length(text) - 4000 as varchar) || ' characters more)' else text end as observation from documents")
def trimmed_observations(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", agent.trim_observation(F.col("text")).alias("observation"))


@query("select event_id, case when event_id % 3 = 0 then 'view ' || event_type when event_id % 3 = 1 then event_type else substring(event_type || ' said', 1, 80) end as headline from events")
def headlines(spark, sf_dir):
    n = F.col("event_id")
    payload = F.when(n % 3 == 0, F.to_json(F.struct(F.lit("").alias("what"), F.concat(F.lit("view "), "event_type").alias("description")))).when(n % 3 == 1, F.to_json(F.struct(F.col("event_type").alias("text")))).otherwise("{}")
    return table(spark, sf_dir, "events").select("event_id", tx.headline(payload, F.concat("event_type", F.lit(" said"))).alias("headline"))


@query("select event_id, '{\"k\": ' || cast(event_id as varchar) || '}' as inner_text, case when event_id % 2 = 0 then event_type else 'given' end as named from events")
def fences_and_aliases(spark, sf_dir):
    body = F.concat(F.lit('{"k": '), F.col("event_id").cast("string"), F.lit("}"))
    fenced = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```\n"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" ```"), body, F.lit("``` "))).otherwise(F.concat(F.lit("  "), body))
    empty = F.when(F.col("event_id") % 2 == 1, F.lit("given")).otherwise(F.lit(""))
    return table(spark, sf_dir, "events").select("event_id", tx.strip_fence(fenced).alias("inner_text"), tx.first_filled(F.lit(None), empty, F.col("event_type")).alias("named"))


@query(f"with {SAID} select source_id, turn, clock as ts, cast(turn * 7 as double) as seconds, '[' || clock || '] ' || role || ': ' || text as line from said")
def rendered_segments(spark, sf_dir):
    pair = dates.normalise_timestamp((F.col("turn") * 7).cast("string"))
    return _said(spark, sf_dir).select("source_id", "turn", pair["ts"].alias("ts"), pair["seconds"].cast("double").alias("seconds"), tx.render_segment(F.col("clock"), F.col("role"), F.col("text")).alias("line"))


@query("select vec_id, round(list_dot_product(u, u), 5) as norm, round(u[1], 5) as first from (select vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as u from (select vec_id, cast(embedding as double[]) as e from embeddings))")
def unit_vectors(spark, sf_dir):
    unit = table(spark, sf_dir, "embeddings").select("vec_id", vectors.l2_normalise(F.col("embedding")).alias("u"))
    return unit.select("vec_id", F.round(vectors.dot(F.col("u"), F.col("u")), 5).alias("norm"), F.round(F.get("u", F.lit(0)), 5).alias("first"))


@query(f"""with {ITEMS} select id, 'room' || cast(id % 3 as varchar) as scope_key from items where kind = 'signal' and status = 'approved' and id % 4 = 3 and id % 8 = 7""")
def channel_signals(spark, sf_dir):
    own = items(spark, sf_dir).drop("scope_key").withColumn("message_id", F.col("id"))
    messages = table(spark, sf_dir, "documents").where("doc_id % 8 = 7").select(F.col("doc_id").alias("id"), F.concat(F.lit("room"), (F.col("doc_id") % 3).cast("string")).alias("channel"))
    return rollups.in_channel(own, messages.unionByName(messages)).select("id", "scope_key")


@query("select distinct source as scope_key, '#' || source as scope_title from documents union all select distinct 'c' || cast(conv_id as varchar), 'Talk ' || cast(conv_id as varchar) from conversations where conv_id % 7 <> 3")
def digest_scope_list(spark, sf_dir):
    messages = table(spark, sf_dir, "documents").select(F.col("source").alias("channel"))
    talks = _sources(spark, sf_dir).where("source_id like 'c%'").withColumns({"source_type": F.lit("transcript"), "status": F.when(F.col("consent_flag"), "ingested").otherwise("refused")})
    return rollups.digest_scopes(messages, talks)


@query(f"""with {SAID}, {SEG} select s.source_id, count(*) as segments, count(*) filter (s.text <> '') as spoken from said s group by 1""")
def parsed_reports(spark, sf_dir):
    """Counts of what the parsers found, and of segments that validation lets through."""
    line = F.concat(F.lit("["), "clock", F.lit("] "), "role", F.lit(": "), "text")
    parsed = segments.validate_segments(files.parse_files(_as_files(_said(spark, sf_dir), "txt", line, "\n")), False)
    return parsed.select("source_id", F.size("segments").cast("long").alias("segments"), F.size(F.filter("segments", lambda s: s["text"] != "")).cast("long").alias("spoken"))


# --- metrics ------------------------------------------------------------------------------------


@query("""select count(*) filter (doc_id % 5 <> 0) as named, count(*) filter (doc_id % 5 <> 0 and doc_id % 3 <> 0) as named_right, count(*) filter (doc_id % 5 = 0) as unspecified, count(*) filter (doc_id % 5 = 0 and doc_id % 3 = 0) as unspecified_kept from documents""")
def owner_accuracy(spark, sf_dir):
    n = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.when(n % 5 == 0, "UNSPECIFIED").otherwise(F.concat(F.lit("P"), n.cast("string"))).alias("golden_owner"), F.when(n % 3 == 0, "UNSPECIFIED").otherwise(F.concat(F.lit(" p"), n.cast("string"), F.lit(" "))).alias("owner"))
    return evaluation.owner_scores(rows)


@query("""select count(*) filter (doc_id % 2 = 0 and (doc_id % 5 = 0 or doc_id % 7 = 0)) as invented, count(*) filter (doc_id % 4 = 1) as resolved from documents""")
def invented_dates(spark, sf_dir):
    n = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        F.when(n % 5 == 0, "UNSPECIFIED").otherwise("2024-02-01").alias("golden_due"), F.when(n % 2 == 0, "2024-02-01").otherwise("UNSPECIFIED").alias("due_date"),
        F.when(n % 4 == 1, "relative_resolved").otherwise("absolute").alias("date_type"), F.when(n % 7 == 0, " ").otherwise("friday").alias("stated"),
    )
    return evaluation.date_scores(rows)


@query("""select count(*) filter (doc_id % 3 = 0) as high, count(*) filter (doc_id % 3 = 0 and (doc_id % 2 = 0 or regexp_matches(lower(text), """ + "'" + "|".join(w.replace("'", "''") for w in evaluation.CONSEQUENCES) + """'))) as defensible from documents""")
def severity_check(spark, sf_dir):
    n = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.when(n % 3 == 0, "high").otherwise("low").alias("severity"), F.when(n % 2 == 0, F.concat("text", F.lit(" We MISSED it"))).otherwise(F.col("text")).alias("quote"))
    return evaluation.severity_defensible(rows)


@query("select count(*) as stored, count(*) filter (doc_id % 6 = 0) as leaks from documents where doc_id % 2 = 0")
def leak_count(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return evaluation.direct_message_leaks(d.where("id % 2 = 0"), d.where("id % 3 = 0").unionByName(d.where("id % 6 = 0")))


@query("""select lang, count(*) filter (doc_id % 4 > 1) as matched, count(*) filter (doc_id % 4 = 0) as missed, count(*) filter (doc_id % 4 = 1) as false_positives,
round(coalesce(count(*) filter (doc_id % 4 > 1) / nullif(count(*) filter (doc_id % 4 <> 1), 0), 0), 6) as recall, round(coalesce(count(*) filter (doc_id % 4 > 1) / nullif(count(*) filter (doc_id % 4 <> 0), 0), 0), 6) as precision from documents group by 1""")
def pair_scores(spark, sf_dir):
    n = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("lang", F.when(n % 4 != 1, n).alias("golden_id"), F.when(n % 4 != 0, n).alias("extraction_id"))
    return evaluation.recall_precision(rows, "lang").withColumns({"recall": F.round("recall", 6), "precision": F.round("precision", 6)})


@query(f"""with {SAID}, g as (select source_id, turn, lower(text) as q, turn % 3 = 0 as deferred from said where text <> ''), d as (select source_id, lower(substring(text, 3, 40)) as q from said where turn % 2 = 0),
m as (select g.*, exists (select 1 from d where d.source_id = g.source_id and trim(d.q) <> '' and (contains(g.q, trim(d.q)) or contains(trim(d.q), g.q))) as found from g)
select count(*) filter (not deferred) as decided, count(*) filter (not deferred and found) as found, count(*) filter (deferred) as deferred, count(*) filter (deferred and found) as deferred_recorded,
round(count(*) filter (not deferred and found) / nullif(count(*) filter (not deferred), 0), 6) as recall from m""")
def decision_recall(spark, sf_dir):
    said = _said(spark, sf_dir)
    golden = said.where("text <> ''").select("source_id", F.concat_ws("#", "source_id", "turn").alias("golden_id"), F.col("text").alias("quote"), (F.col("turn") % 3 == 0).alias("deferred"))
    return evaluation.decision_scores(golden, said.where("turn % 2 = 0").select("source_id", F.substring("text", 3, 40).alias("quote"))).withColumn("recall", F.round("recall", 6))


@query(f"""with {SEGTEXT}, q as (select source_id, min(segment_index) + 1 as wanted from seg group by 1)
select 'all' as mode, q.source_id as question_id, cast(min(case when s.source_id = q.source_id then 1 + (s.segment_index * 7 + s.source_id) % 9 end) as integer) as source_rank,
cast(min(case when s.source_id = q.source_id and s.segment_index = q.wanted then 1 + (s.segment_index * 7 + s.source_id) % 9 end) as integer) as rank
from q join st0 s on s.source_id = q.source_id or s.source_id = q.source_id + 1 group by 1, 2""")
def question_ranks(spark, sf_dir):
    """Where the expected source and segment come among hits, which are the segments of two conversations here."""
    seg = read_segments(spark, sf_dir).withColumn("start_ts", dates.format_timestamp(F.col("segment_index") * 7))
    first = seg.groupBy("source_id").agg((F.min("segment_index") + 1).alias("wanted"))
    questions = first.select(F.col("source_id").alias("question_id"), "source_id", dates.format_timestamp(F.col("wanted") * 7).alias("start_ts"))
    rank = (1 + (F.col("segment_index") * 7 + F.col("source_id")) % 9).cast("int").alias("rank")
    own = seg.select(F.lit("all").alias("mode"), F.explode(F.array(F.col("source_id"), F.col("source_id") - 1)).alias("question_id"), "source_id", F.col("segment_id").alias("ref_id"), rank)
    return evaluation.expected_ranks(questions, seg, own)


QUERIES, ORACLES = query.queries, query.oracles
