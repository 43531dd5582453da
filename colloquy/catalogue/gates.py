"""Review, gates, tracker, digests, people, records, evaluation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from colloquy.catalogue.common import ITEMS, REVIEWS, Register, items, reviewed, reviews
from colloquy.catalogue.texts import SPACES, WORDS
from colloquy.operators import evaluation, grouped, review, rollups, rules, signals, tracker
from colloquy.sources.tables import table

query = Register()
NOW = dt.datetime(1996, 6, 1)


@query("select o_orderkey as id, o_orderdate + interval 72 hour as expires_at from orders where o_orderstatus = 'O' and o_orderdate + interval 72 hour <= timestamp '1996-06-01'")
def expiry_sweep(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("approved").alias("status"), F.col("o_orderdate").alias("created_at"))
    return review.stale(review.with_expiry(o), NOW).select("id", "expires_at")


@query(f"with {ITEMS} select count(*) filter (status = 'pending') as pending, count(*) filter (status = 'approved') as approved, count(*) filter (status = 'rejected') as rejected, count(*) filter (status = 'expired') as expired, count(*) filter (status = 'pending' and not quote_verified) as unverified_pending from items")
def review_summary(spark, sf_dir):
    return review.summary(items(spark, sf_dir))


JUDGED = f"""{REVIEWS},
own as (select *, case when event_type in ('approved', 'rejected') and trim(actor) = '' then 'no_actor'
  when event_type = 'approved' and not quote_verified and not override then 'needs_override'
  when event_type = 'approved' and not quote_verified and coalesce(trim(note), '') = '' then 'needs_note' end as problem0 from ev),
judged as (select *, case when coalesce(sum(case when problem0 is null and event_type in ('approved', 'rejected', 'expired') then 1 else 0 end)
  over (partition by extraction_id order by created_at, seq rows between unbounded preceding and 1 preceding), 0) > 0 then 'not_pending' else problem0 end as problem from own)"""


@query(f"with {JUDGED} select extraction_id, seq, event_type, problem from judged")
def review_rules(spark, sf_dir):
    return review.judge_events(reviews(spark, sf_dir), reviewed(spark, sf_dir)).select("extraction_id", "seq", "event_type", "problem")


@query(f"""with {JUDGED} select extraction_id as id, coalesce(arg_min(event_type, seq) filter (problem is null and event_type in ('approved', 'rejected', 'expired')), 'pending') as status,
arg_min(actor, seq) filter (problem is null and event_type in ('approved', 'rejected', 'expired')) as reviewer, count(*) filter (problem is null and event_type = 'edited') as edits from judged group by extraction_id""")
def review_state_fold(spark, sf_dir):
    return review.fold_state(reviewed(spark, sf_dir), reviews(spark, sf_dir))


@query(f"""with {REVIEWS} select extraction_id, actor as approved_by, created_at as approved_at from ev where event_type = 'approved'
qualify row_number() over (partition by extraction_id order by created_at, seq) = 1""")
def first_approval(spark, sf_dir):
    return review.first_approvals(reviews(spark, sf_dir))


@query(f"""with {REVIEWS}, w as (select *, lag(event_type) over (partition by extraction_id order by created_at, seq) as previous_status from ev)
select extraction_id, seq, previous_status from w where previous_status in ('approved', 'rejected', 'expired')""")
def terminal_reopened(spark, sf_dir):
    return rules.terminal_reopened(reviews(spark, sf_dir).withColumn("status_after", F.col("event_type"))).select("extraction_id", "seq", "previous_status")


@query("select l_orderkey as extraction_id, l_linenumber from lineitem where exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus = 'F')")
def approval_gate(spark, sf_dir):
    writes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("extraction_id"), "l_linenumber")
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending").alias("status"))
    return rules.approval_gate(writes, own)[0]


@query("select doc_id as id, source as source_id from documents where source not in ('src1', 'src3')")
def consent_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"))
    agreed = d.select("source_id").distinct().withColumn("consent_flag", ~F.col("source_id").isin("src1", "src3"))
    return rules.consent_gate(d, agreed)[0]


@query("select l_orderkey, count(*) as n from lineitem group by 1 having count(*) > 1")
def uniqueness_violations(spark, sf_dir):
    return rules.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("select doc_id from labels l where not exists (select 1 from documents d where d.doc_id = l.doc_id)")
def orphan_rows(spark, sf_dir):
    return rules.orphans(table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents"), "doc_id", "doc_id")


@query("""with r as (select l_orderkey as extraction_id, l_linenumber as seq from lineitem)
select extraction_id, seq, case when o_orderstatus <> 'F' then 'blocked' when o_orderkey % 5 = 0 or row_number() over (partition by extraction_id order by seq) > 1 then 'deduplicated' else 'created' end as outcome
from r join orders on o_orderkey = extraction_id""")
def idempotent_write(spark, sf_dir):
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("extraction_id"), F.col("l_linenumber").alias("seq"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending").alias("status"))
    done = o.where("id % 5 = 0").select(F.col("id").alias("extraction_id"), F.concat(F.lit("MOCK-"), F.col("id")).alias("external_ref"))
    return tracker.write_outcomes(asked, o, done).select("extraction_id", "seq", "outcome")


@query(f"""with {ITEMS} select id as source_ref, 'Untitled action' as title, nullif(owner, 'UNSPECIFIED') as assignee, nullif(due_date, 'UNSPECIFIED') as due_date,
concat_ws(',', 'meeting-agent', kind, case when owner = 'UNSPECIFIED' then 'needs-owner' end, case when due_date = 'UNSPECIFIED' then 'needs-date' end, case when not quote_verified then 'unverified-quote' end) as labels
from items where kind = 'action' and status = 'approved'""")
def tracker_drafts(spark, sf_dir):
    own = items(spark, sf_dir).where("extraction_type = 'action' and status = 'approved'")
    own = own.withColumns({"source_id": F.col("scope_key"), "verbatim_quote": F.col("text"), "speaker": F.lit(None).cast("string"), "timestamp": F.lit(None).cast("string")})
    return tracker.build_drafts(own).select("source_ref", "title", "assignee", "due_date", F.array_join("labels", ",").alias("labels"))


@query(f"""with {ITEMS}, a as (select * from items where status = 'approved'),
att as (select *, case when kind = 'risk' then case severity when 'high' then 0 when 'medium' then 1 end when kind = 'signal' and classification = 'blocker' then 0 when kind = 'action' and owner = 'UNSPECIFIED' then 2 end as u from a),
one as (select *, row_number() over (partition by scope_key order by u, quote_verified nulls first, confidence desc nulls last, char_start nulls first, id) as position from att where u is not null qualify position <= 2),
r1 as (select * from a where id not in (select id from one)),
ch as (select *, case when kind = 'action' and owner = 'UNSPECIFIED' and due_date = 'UNSPECIFIED' then 0 when kind = 'signal' and classification = 'request' then 1 end as c from r1),
two as (select *, row_number() over (partition by scope_key order by c, quote_verified nulls first, confidence desc nulls last, char_start nulls first, id) as position from ch where c is not null qualify position <= 1),
r2 as (select *, approved_on = date '2024-01-10' as t, bool_or(approved_on = date '2024-01-10') over (partition by scope_key) as anyt from r1 where id not in (select id from two)),
three as (select *, row_number() over (partition by scope_key order by case when t then null else approved_on end desc nulls last, quote_verified nulls first, confidence desc nulls last, char_start nulls first, id) as position from r2 where t or not anyt qualify position <= 3)
select scope_key, id, 'attention' as section, cast(position as integer) as position, case when kind = 'risk' then severity || ' severity risk' when kind = 'signal' then 'blocker' else 'action without owner' end as because from one
union all select scope_key, id, 'to_decide', cast(position as integer), case c when 0 then 'no owner and no date' else 'open request' end from two
union all select scope_key, id, 'moved', cast(position as integer), case when t then 'approved today' else 'last approved' end from three""")
def digest_sections(spark, sf_dir):
    return rollups.digest_sections(items(spark, sf_dir).where("status = 'approved'"), dt.date(2024, 1, 10))


@query(f"""with {ITEMS}, o as (select owner, id from items where kind = 'action'),
k as (select case when owner = 'UNSPECIFIED' then 'unassigned' else lower(split_part(owner, ' ', 1)) end as person_key, owner as alias, min(id) as seq, count(*) as n from o group by 1, 2)
select person_key, case when person_key = 'unassigned' then 'Assignee unspecified' when count(*) = 1 then any_value(alias) else split_part(arg_min(alias, seq), ' ', 1) end as display_name,
string_agg(alias, ',' order by seq) as aliases, person_key <> 'unassigned' and count(*) > 1 as ambiguous, cast(sum(n) as bigint) as n_items from k group by person_key""")
def person_groups(spark, sf_dir):
    own = items(spark, sf_dir).where("extraction_type = 'action'").select("owner", F.col("id").alias("seq"))
    return rollups.person_groups(own).withColumn("aliases", F.array_join("aliases", ","))


@query(f"""with {ITEMS} select id, due_date, cast(approved_on as varchar) as approved_on, cast(row_number() over (partition by case when owner = 'UNSPECIFIED' then 'unassigned' else lower(split_part(owner, ' ', 1)) end
order by due_date = 'UNSPECIFIED', approved_on nulls first, cast(id as varchar)) as integer) as position, case when owner = 'UNSPECIFIED' then 'unassigned' else lower(split_part(owner, ' ', 1)) end as person_key
from items where kind = 'action' and status = 'approved'""")
def person_digests(spark, sf_dir):
    own = items(spark, sf_dir).withColumns({"id": F.col("id").cast("string"), "source_id": F.col("scope_key"), "verbatim_quote": F.col("text")})
    titles = own.select("source_id").distinct().withColumn("title", F.col("source_id"))
    approvals = own.select(F.col("id").alias("extraction_id"), F.col("approved_on").alias("approved_at"))
    told = rollups.person_digests(own.drop("approved_on"), titles, approvals)
    return told.select("person_key", F.col("id").cast("long").alias("id"), "due_date", F.col("approved_on").cast("string").alias("approved_on"), "position")


@query(f"""with {ITEMS} select scope_key as source_id, count(*) filter (kind = 'action' and status = 'approved') as actions, count(*) filter (kind = 'decision' and status = 'approved') as decisions,
count(*) filter (kind = 'risk' and status = 'approved') as risks, count(*) filter (kind = 'signal' and status = 'approved') as signals, count(*) filter (status = 'pending') as pending_not_included,
count(*) filter (status = 'rejected') as rejected_not_included, count(*) filter (status = 'expired') as expired_not_included from items group by 1""")
def outcome_rollup(spark, sf_dir):
    own = items(spark, sf_dir)
    null = F.lit(None).cast("string")
    own = own.withColumns({"source_id": F.col("scope_key"), "verbatim_quote": F.substring("text", 1, 80), "original_payload": F.col("payload"), "speaker": null, "timestamp": null})
    sources = own.select("source_id").distinct().withColumns({"consent_flag": F.lit(True), "title": F.col("source_id"), "meeting_date": F.lit("2024-01-10").cast("date"), "participants": F.array().cast("array<string>")})
    approvals = own.where("status = 'approved'").select(F.col("id").alias("extraction_id"), F.lit("Ada").alias("approved_by"), F.col("approved_on").alias("approved_at"))
    told = rollups.outcome_records(own, sources, approvals)
    return told.select("source_id", *[F.size(f"{k}s").cast("long").alias(f"{k}s") for k in ("action", "decision", "risk", "signal")], "pending_not_included", "rejected_not_included", "expired_not_included")


@query(f"with {ITEMS} select scope_key as source_id, 'Recap: ' || scope_key as subject, count(*) as item_count, 'draft' as status from items where status = 'approved' and kind in ('action', 'decision', 'risk') group by 1")
def followup_drafts(spark, sf_dir):
    null = F.lit(None).cast("string")
    own = items(spark, sf_dir).withColumns({"source_id": F.col("scope_key"), "verbatim_quote": F.col("text"), "speaker": null, "timestamp": null})
    sources = own.select("source_id").distinct().withColumns({"title": F.col("source_id"), "meeting_date": F.lit("2024-01-10").cast("date")})
    return rollups.followup_drafts(own, sources).select("source_id", "subject", "item_count", "status")


@query("""select d.doc_id as id, case when l.toxic = 1 then 'queued' when l.quality = 0 then 'discarded' else 'stored' end as route from documents d left join labels l using (doc_id)""")
def signal_routes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    label = F.when(F.col("toxic") == 1, "blocker").when(F.col("quality") == 0, "noise").otherwise("question")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("message_id"), label.alias("classification"), F.lit(1.0).alias("confidence"))
    return signals.classify(d, labels).select("id", signals.route().alias("route"))


@query("""select doc_id as message_id, 'missing' as problem from documents where doc_id not in (select doc_id from labels) union all select distinct doc_id, 'unknown' from labels where doc_id not in (select doc_id from documents)""")
def answer_problems(spark, sf_dir):
    return signals.answer_problems(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("message_id")))


JUDGMENT = "j as (select d.doc_id, cast(l.quality * 2 + l.toxic as varchar) as truth, case when doc_id % 4 = 0 then null else cast(doc_id % 4 as varchar) end as predicted, (doc_id % 11) / 10.0 as confidence, doc_id % 3 <> 0 as correct from labels l join documents d using (doc_id))"


def _judged(spark, sf_dir):
    n = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return rows.select(
        n, (F.col("quality") * 2 + F.col("toxic")).cast("string").alias("truth"), F.when(n % 4 != 0, (n % 4).cast("string")).alias("predicted"), ((n % 11) / 10.0).alias("confidence"), (n % 3 != 0).alias("correct")
    )


@query(f"""with {JUDGMENT}, p as (select truth, coalesce(predicted, 'noise') as predicted from j), l as (select truth as label from p union select predicted from p)
select label, count(*) filter (predicted = label and truth = label) as tp, count(*) filter (predicted = label and truth <> label) as fp, count(*) filter (predicted <> label and truth = label) as fn,
round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall from l, p group by label""")
def class_precision_recall(spark, sf_dir):
    told = evaluation.class_scores(_judged(spark, sf_dir))
    return told.select("label", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"""with {JUDGMENT} select t as threshold, count(*) filter (confidence >= t) as kept, count(*) filter (confidence >= t and correct) as correct,
round(count(*) filter (confidence >= t and correct) / nullif(count(*) filter (confidence >= t), 0), 3) as precision, round(count(*) filter (confidence >= t and correct) / nullif(count(*) filter (correct), 0), 3) as recall
from j, (select unnest([0.0::double, 0.5, 0.7, 0.8, 0.9]) as t) group by t""")
def calibration(spark, sf_dir):
    return evaluation.calibration(_judged(spark, sf_dir))


@query("""with r as (select event_type as mode, user_id as question_id, min(case when event_id % 6 = 0 then null else event_id % 9 + 1 end) as rank from events group by 1, 2)
select mode, count(*) as questions, count(*) filter (rank <= 3) as hits, round(avg(coalesce(rank, 99)), 6) as mean_rank from r group by mode""")
def hit_at_k(spark, sf_dir):
    ranks = table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), F.col("user_id").alias("question_id"), F.when(F.col("event_id") % 6 != 0, F.col("event_id") % 9 + 1).alias("rank"))
    return evaluation.hit_at_k(ranks).withColumn("mean_rank", F.round("mean_rank", 6))


@query("""select event_type as "case", count(*) as runs, min(value) as lowest, max(value) as highest, round(max(value) - min(value), 6) as spread, count(distinct value) = 1 as stable from events group by 1""")
def multi_run_spread(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("case"), F.col("user_id").alias("run"), F.col("value").alias("measured"))
    return evaluation.run_spread(runs).withColumn("spread", F.round("spread", 6))


def _candidates(spark, sf_dir):
    """Two neighbouring turns of a conversation are a candidate each; owner is the role."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("source_id"), F.lit("action").alias("extraction_type"), F.col("turn").cast("string").alias("key"), F.col("text").alias("quote"), F.col("text").alias("task"),
        F.col("role").alias("owner"), ((F.col("turn") % 4) / 4.0).alias("confidence"), (F.col("turn") * 100).cast("int").alias("char_start"), (F.col("turn") * 100 + 150).cast("int").alias("char_end"),
    )


#: The candidates as SQL, with their words and their ranks.
CANDIDATES = f"""
cand as (select cast(conv_id as varchar) as source_id, cast(turn as varchar) as key, trim(regexp_replace(text, {SPACES})) as quote, {WORDS.format("text")} as words, role as owner,
  case when turn % 4 = 0 then 0.5 else (turn % 4) / 4.0 end as confidence, cast(turn * 100 as integer) as s, cast(turn * 100 + 150 as integer) as e from conversations)
"""


@query(f"""with recursive {CANDIDATES},
ranked as (select *, cast(row_number() over (partition by source_id order by confidence desc, s, key) as integer) as r from cand),
pairs as (select a.source_id, b.r, a.r as t, a.quote = b.quote as same, greatest(least(a.e, b.e) - greatest(a.s, b.s), 0) / 150.0 as overlap, a.owner = b.owner as owned,
  case when least(len(a.words), len(b.words)) < 2 then 0.0 else len(list_intersect(a.words, b.words)) / least(len(a.words), len(b.words)) end as likeness
  from ranked a join ranked b on a.source_id = b.source_id and a.r < b.r),
told as (select source_id, r, t, case when likeness >= 0.4 and same then 'identical_quote' when likeness >= 0.4 and overlap >= 0.5 then 'overlapping_span' when likeness >= 0.7 and owned then 'same_owner' end as reason from pairs),
earlier as (select source_id, r, list(t order by t) as ts, list(reason order by t) as reasons from told where reason is not null group by source_id, r),
nodes as (select ranked.source_id, ranked.r, key, coalesce(ts, []) as ts, coalesce(reasons, []) as reasons from ranked left join earlier using (source_id, r)),
walk(source_id, r, acc, reason) as (
  select source_id, 1, [1], cast(null as varchar) from nodes where r = 1
  union all
  select n.source_id, n.r, list_append(w.acc, coalesce(list_filter(n.ts, lambda t: w.acc[t] = t)[1], n.r)),
    n.reasons[list_position(n.ts, list_filter(n.ts, lambda t: w.acc[t] = t)[1])]
  from walk w join nodes n on n.source_id = w.source_id and n.r = w.r + 1)
select n.source_id, 'action' as extraction_type, n.key, o.key as survivor_key, w.reason
from walk w join nodes n using (source_id, r) join nodes o on o.source_id = w.source_id and o.r = w.acc[w.r]""")
def greedy_dedup(spark, sf_dir):
    return grouped.greedy_dedup(_candidates(spark, sf_dir))


@query(f"""with recursive {CANDIDATES},
g as (select source_id, key, quote, words, cast(row_number() over (partition by source_id order by s, key) as integer) as r from cand where owner = 'user'),
e as (select source_id, key, quote, words, cast(row_number() over (partition by source_id order by s, key) as integer) as r from cand where owner <> 'user'),
met as (select g.source_id, g.r, e.r as er, g.quote <> '' and e.quote <> '' and (contains(lower(g.quote), lower(e.quote)) or contains(lower(e.quote), lower(g.quote))) as quoted,
  case when least(len(g.words), len(e.words)) < 2 then 0.0 else len(list_intersect(g.words, e.words)) / least(len(g.words), len(e.words)) end >= 0.5 as alike
  from g join e using (source_id)),
items as (select g.source_id, g.r, coalesce(list(er order by er) filter (quoted), []) as first_choice, coalesce(list(er order by er) filter (quoted or alike), []) as second_choice
  from g left join met using (source_id, r) group by g.source_id, g.r),
steps as (select source_id, 1 as pass_no, r, first_choice as offers, r as k from items
  union all select source_id, 2, r, second_choice, r + (select max(r) from g x where x.source_id = items.source_id) from items),
walk(source_id, k, gs, es, ps) as (
  select distinct source_id, 0, cast([] as integer[]), cast([] as integer[]), cast([] as integer[]) from g
  union all
  select w.source_id, s.k,
    case when c.e is null then gs else list_append(gs, s.r) end, case when c.e is null then es else list_append(es, c.e) end, case when c.e is null then ps else list_append(ps, s.pass_no) end
  from walk w join steps s on s.source_id = w.source_id and s.k = w.k + 1,
    lateral (select case when list_contains(w.gs, s.r) then null else list_filter(s.offers, lambda x: not list_contains(w.es, x))[1] end as e) c),
ended as (select source_id, unnest(gs) as gr, unnest(es) as er, unnest(ps) as pass_no from (select *, row_number() over (partition by source_id order by k desc) as n from walk) where n = 1)
select g.source_id as group_id, g.key as golden_id, e.key as extraction_id, pass_no from g left join ended on ended.source_id = g.source_id and gr = g.r left join e on e.source_id = g.source_id and e.r = er
union all
select source_id, null, key, null from e where not exists (select 1 from ended where ended.source_id = e.source_id and er = e.r)""")
def greedy_pairing(spark, sf_dir):
    c = _candidates(spark, sf_dir).withColumn("position", F.col("char_start"))
    golden = c.where("owner = 'user'").select(F.col("source_id").alias("group_id"), F.col("key").alias("golden_id"), "position", "quote", "task")
    told = c.where("owner <> 'user'").select(F.col("source_id").alias("group_id"), F.col("key").alias("extraction_id"), "position", "quote", "task")
    return grouped.greedy_pairs(golden, told)


QUERIES, ORACLES = query.queries, query.oracles
