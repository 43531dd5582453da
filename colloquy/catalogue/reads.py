"""Scans, filters, joins, aggregates and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalogue.common import ITEMS, SEG, Register, items
from colloquy.operators import relational as rel
from colloquy.operators import rollups, segments
from colloquy.sources.tables import segments as read_segments
from colloquy.sources.tables import table

query = Register()


@query("select r_regionkey, r_name from region where r_regionkey = 2")
def point_lookup(spark, sf_dir):
    return rel.top_k(table(spark, sf_dir, "region").where(F.col("r_regionkey") == 2).select("r_regionkey", "r_name"), 1, F.col("r_regionkey"))


@query("select p_partkey, p_name from part where p_brand = 'Brand#13' and p_size = 10")
def equality_filters(spark, sf_dir):
    return table(spark, sf_dir, "part").where(rel.all_of(p_brand="Brand#13", p_size=10, p_type=None)).select("p_partkey", "p_name")


@query("select d.doc_id, (l.quality is not null) as is_labelled from documents d left join labels l using (doc_id) where l.quality is null")
def tri_state_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.where(rel.tri_state("quality", False)).select("doc_id", F.col("quality").isNotNull().alias("is_labelled"))


@query("select s_suppkey, s_nationkey from supplier where s_nationkey in (1, 3, 5, 7)")
def in_list_scope(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where(rel.in_scope("s_nationkey", {1, 3, 5, 7})).select("s_suppkey", "s_nationkey")


@query("select o_orderkey, o_totalprice from orders where o_totalprice between 1000 and 50000")
def between_filter(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(F.col("o_totalprice").between(1000, 50000)).select("o_orderkey", "o_totalprice")


@query("select d.doc_id, l.toxic from documents d left join labels l using (doc_id) where l.toxic is distinct from 1")
def null_safe_inequality(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.where(rel.differs(F.col("toxic"), 1))


@query("select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey where lower(trim(c_mktsegment)) = 'building'")
def normalised_equality(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where(rel.same_text(F.col("c_mktsegment"), F.lit(" Building ")))
    return c.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("select o_orderstatus, count(*) as n from orders group by 1")
def count_by_status(spark, sf_dir):
    return rel.count_by(table(spark, sf_dir, "orders"), "o_orderstatus")


@query("select coalesce(cast(l.quality as varchar), 'unclassified') as quality, count(*) as n from documents d left join labels l using (doc_id) group by 1")
def count_unclassified(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rel.count_by(rows, "quality")


USAGE = "count(*) as attempts, count(distinct user_id) as calls, count(*) filter (event_id % 4 = 0) as cache_hits, cast(coalesce(sum(event_id % 100), 0) as bigint) as input_tokens, cast(coalesce(sum(event_id % 10), 0) as bigint) as output_tokens, round(coalesce(sum(value), 0), 2) as latency_ms"


def _usage(spark, sf_dir, keys=None):
    n = F.col("event_id")
    calls = table(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), "event_type", (n % 4 == 0).alias("cache_hit"), (n % 100).alias("input_tokens"), (n % 10).alias("output_tokens"), F.col("value").alias("latency_ms"))
    told = rollups.usage_summary(calls, keys)
    return told.withColumns({c: F.round(c, d) for c, d in (("latency_ms", 2), ("cache_hit_rate", 6), ("retry_rate", 6))})


@query(f"select *, round(coalesce(cache_hits / attempts, 0), 6) as cache_hit_rate, round(coalesce((attempts - calls) / attempts, 0), 6) as retry_rate from (select {USAGE} from events)")
def usage_summary(spark, sf_dir):
    return _usage(spark, sf_dir)


@query(f"select *, round(coalesce(cache_hits / attempts, 0), 6) as cache_hit_rate, round(coalesce((attempts - calls) / attempts, 0), 6) as retry_rate from (select event_type, {USAGE} from events group by event_type)")
def usage_by_purpose(spark, sf_dir):
    return _usage(spark, sf_dir, ["event_type"])


@query("select conv_id, coalesce(max(turn), 0) + 1 as next_version from conversations group by conv_id")
def next_version(spark, sf_dir):
    return rel.next_version(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("select coalesce(max(try_cast(regexp_extract('MOCK-' || c_custkey, '^MOCK-(\\d+)$', 1) as bigint)), 0) + 1 as next_number from customer")
def next_reference(spark, sf_dir):
    refs = table(spark, sf_dir, "customer").select(F.concat(F.lit("MOCK-"), F.col("c_custkey")).alias("ref"))
    return rel.next_reference(refs, "ref")


@query("select distinct role as speaker from conversations where role is not null")
def distinct_speakers(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role is not null").select(F.col("role").alias("speaker")).distinct()


@query("select conv_id, arg_max(role, turn) as last_role, arg_min(text, turn) as first_text from conversations group by conv_id")
def first_last(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role"), F.min_by("text", "turn").alias("first_text"))


@query("select o_orderkey, o_orderdate, o_totalprice from orders order by o_orderdate desc nulls last, o_totalprice desc nulls last, o_orderkey limit 20")
def recent_top_k(spark, sf_dir):
    return rel.top_k(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), 20, F.col("o_orderdate").desc(), F.col("o_totalprice").desc(), F.col("o_orderkey"))


@query(f"with {ITEMS} select id, quote_verified, confidence, char_start from items where status = 'pending' order by quote_verified nulls first, confidence desc nulls last, char_start nulls first, id limit 50")
def review_queue(spark, sf_dir):
    from colloquy.operators.review import queue_order

    return rel.top_k(items(spark, sf_dir).where("status = 'pending'").select("id", "quote_verified", "confidence", "char_start"), 50, *queue_order())


@query("select c.c_custkey, n.n_name as title from customer c left join nation n on c.c_nationkey = n.n_nationkey and n.n_regionkey = 1")
def left_join_titles(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("title"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(n, "c_nationkey", "left").select("c_custkey", "title")


@query("select n_nationkey, r_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all")
def equi_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return c.join(table(spark, sf_dir, "nation"), "n_nationkey").join(r, "n_regionkey").select("n_nationkey", "r_name", "n")


@query("select doc_id, source from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 0)")
def channel_semi_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").where("toxic = 0").select("doc_id"), "doc_id", "left_semi")


@query("select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def missing_labels_anti(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query(f"""with {SEG}, roles as (select unnest(['system', 'user', 'assistant']) as p),
sources as (select distinct source_id from seg)
select source_id, count(*) filter (not exists (select 1 from seg where seg.source_id = s.source_id and speaker = p)) as n_silent,
  string_agg(p, ',' order by p) filter (not exists (select 1 from seg where seg.source_id = s.source_id and speaker = p)) as silent
from sources s, roles group by source_id""")
def silent_participants_anti(spark, sf_dir):
    seg = read_segments(spark, sf_dir)
    sources = seg.select("source_id").distinct().withColumn("participants", F.array(*[F.lit(x) for x in ("system", "user", "assistant")]))
    told = segments.silent_participants(sources, seg)
    return told.select("source_id", F.size("silent").cast("long").alias("n_silent"), F.nullif(F.array_join(F.array_sort("silent"), ","), F.lit("")).alias("silent"))


@query(f"""with {SEG}, hits as (select source_id, max(segment_index) as segment_index from seg group by source_id)
select s.source_id, s.segment_index, cast(1 as integer) as rank from seg s join hits h on s.source_id = h.source_id
where abs(s.segment_index - h.segment_index) <= 2 and s.segment_index <> h.segment_index""")
def neighbour_band_join(spark, sf_dir):
    seg = read_segments(spark, sf_dir)
    hits = seg.groupBy("source_id").agg(F.max("segment_index").alias("segment_index")).withColumn("rank", F.lit(1))
    return segments.neighbours(hits, seg, 2).select("source_id", "segment_index", "rank")


@query(f"with {ITEMS} select 'segment' as ref_type, cast(conv_id as varchar) || '::seg' || lpad(cast(turn as varchar), 4, '0') as ref_id from conversations where role <> 'system' and trim(text) <> '' union all select 'extraction', cast(id as varchar) from items where status = 'approved'")
def indexable_union(spark, sf_dir):
    from colloquy.plans.retrieval import indexable

    seg = read_segments(spark, sf_dir).where("speaker <> 'system'").withColumn("source_id", F.col("source_id").cast("string"))
    agreed = seg.select("source_id").distinct().withColumn("consent_flag", F.lit(True))
    own = items(spark, sf_dir).select(F.col("id").cast("string").alias("id"), F.col("scope_key").alias("source_id"), "status", "payload", F.col("text").alias("verbatim_quote"))
    return indexable(seg, agreed, own).select("ref_type", "ref_id")


@query("select doc_id, sha256(text) as content_hash from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1)")
def content_hash_skip(spark, sf_dir):
    new = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    stored = new.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").withColumn("status", F.lit("ingested"))
    return rel.changed_only(new, stored, "doc_id", "content_hash")


@query("""select coalesce(n.k, s.k) as k, coalesce(n.v, s.v) as v from (select c_custkey as k, c_name as v from customer) s
full outer join (select s_suppkey as k, s_name as v from supplier) n on s.k = n.k""")
def keyed_upsert(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    return rel.upsert(stored, new, "k")


@query("select o_orderkey, coalesce(case when o_orderstatus = 'F' then 'approved' end, o_orderpriority) as state from orders")
def edit_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    edits = o.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("approved").alias("state"))
    return rel.coalesce_update(o.select("o_orderkey", F.col("o_orderpriority").alias("state")), edits, "o_orderkey")


@query("select l.l_orderkey, l.l_linenumber from lineitem l where not exists (select 1 from orders o where o.o_orderkey = l.l_orderkey and o.o_orderstatus = 'P')")
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return rel.without_children(gone, "l_orderkey", table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"))[0]


@query("select event_type, cast(floor((n - 1) / 20) as integer) as batch, count(*) as n from (select event_type, row_number() over (partition by event_type order by ts, event_id) as n from events) group by 1, 2")
def signal_batches(spark, sf_dir):
    from colloquy.operators.signals import signal_batches as batched

    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), "ts", F.col("event_id").alias("id"))
    return batched(rows).groupBy(F.col("channel").alias("event_type"), "batch").agg(F.count("*").alias("n"))


@query("select user_id, event_id, cast(row_number() over (partition by user_id order by ts desc, event_id) as integer) as rank from events qualify rank <= 3")
def rank_limited(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return rel.ranked(rows, ["user_id"], F.col("ts").desc(), F.col("event_id")).where("rank <= 3").drop("ts")


@query("""select user_id, event_id, value, previous from (select user_id, event_id, value,
last_value(value ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as previous from events) where value < previous""")
def monotonic_check(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("segment_index"), F.col("value").alias("start_seconds"))
    back = segments.backward_steps(rows)
    return back.select(F.col("source_id").alias("user_id"), F.col("segment_index").alias("event_id"), F.col("start_seconds").alias("value"), "previous")


@query(f"""with {SEG} select source_id, arg_max(text, segment_index) as last_text from seg group by source_id
having not regexp_matches(rtrim(last_text), '[.!?"'')\\]…”’]$')""")
def truncation_check(spark, sf_dir):
    return segments.truncated(read_segments(spark, sf_dir)).select("source_id", "last_text")


@query(f"with {SEG} select source_id, count(*) as n_segments from seg group by source_id having count(*) < 4")
def minimum_segments(spark, sf_dir):
    return segments.too_short(read_segments(spark, sf_dir), 4)


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_price, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem group by 1, 2")
def lineitem_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )


@query("select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def tumbling_window_extension(spark, sf_dir):
    from colloquy.streaming.jobs import tumbling_counts

    rows = table(spark, sf_dir, "events")
    return tumbling_counts(rows).withColumns({"total": F.round("total", 4), "window_start": F.col("window_start").cast("timestamp_ntz")})


@query("""with g as (select user_id, ts, case when ts - lag(ts) over w <= interval 30 minute then 0 else 1 end as opens from events window w as (partition by user_id order by ts)),
s as (select user_id, ts, sum(opens) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as n from s group by user_id, k""")
def session_window_extension(spark, sf_dir):
    from colloquy.streaming.jobs import sessions

    told = sessions(table(spark, sf_dir, "events"))
    return told.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


QUERIES, ORACLES = query.queries, query.oracles
