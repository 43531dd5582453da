import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import evaluation, grouped, relational, review, rollups, rules, segments, signals, tracker

T0 = dt.datetime(2024, 1, 1)


def test_offsets_resolve_and_gaps_stay(spark):
    rows = [("s", 0, " Hello  there "), ("s", 1, " \t"), ("s", 3, "😀 ok"), ("t", 0, "x")]
    got = segments.normalise_segments(spark.createDataFrame(rows, "source_id string, segment_index int, text string"))
    texts = {r["source_id"]: r["source_text"] for r in segments.source_texts(got).collect()}
    assert texts == {"s": "Hello there 😀 ok", "t": "x"}
    for r in got.collect():
        assert texts[r["source_id"]][r["char_start"] : r["char_end"]] == r["text"]
    assert {r["segment_id"] for r in got.collect()} == {"s::seg0000", "s::seg0003", "t::seg0000"}


def test_neighbours_keep_the_first_hit(spark):
    seg = spark.createDataFrame([("s", i) for i in range(8)], "source_id string, segment_index int")
    hits = spark.createDataFrame([("s", 2, 2), ("s", 4, 1)], "source_id string, segment_index int, rank int")
    got = {(r["segment_index"], r["rank"]) for r in segments.neighbours(hits, seg, 1).collect()}
    assert got == {(1, 2), (3, 1), (5, 1)}
    assert segments.neighbours(hits, seg, 0).count() == 0


def test_validation_finds_defects(spark):
    seg = "array<struct<speaker:string,start_ts:string,end_ts:string,start_seconds:double,text:string,line_number:int>>"
    defects = "array<struct<code:string,severity:string,detail:string,line_number:int,excerpt:string>>"
    row = lambda *xs: [(None, f"t{i}", None, t, x, i) for i, (t, x) in enumerate(xs)]
    rows = [("ok", row((1.0, "a."), (2.0, "b.")), []), ("cut", row((5.0, "a."), (None, "x."), (4.0, "We need to upd")), []), ("one", row((1.0, "a.")), []), ("none", [], [])]
    got = segments.validate_segments(spark.createDataFrame(rows, f"source_id string, segments {seg}, defects {defects}"))
    codes = {r["source_id"]: [d["code"] for d in r["defects"]] for r in got.collect()}
    assert codes == {"ok": [], "cut": ["truncated_mid_sentence", "non_monotonic_timestamp"], "one": ["no_parseable_segments"], "none": ["no_parseable_segments"]}
    lines = {r["source_id"]: r["s"] for r in got.select("source_id", segments.summarise_defects(F.col("defects")).alias("s")).collect()}
    assert lines["ok"] == "" and lines["cut"].startswith("truncated_mid_sentence at line 2")


def slow_windows(costs, budget, overlap):
    """Windows by the definition, checked for coverage and progress."""
    out, start, carried = [], 0, 0
    while True:
        end = max(k for k in range(start + 1, len(costs) + 1) if k == start + 1 or sum(costs[start:k]) <= budget)
        out.append((start, end, carried))
        if end == len(costs):
            return out
        again = min(k for k in range(start + 1, end + 1) if sum(costs[k:end]) <= overlap)
        start, carried = again, end - again


def test_windows_agree_with_their_definition():
    rng = random.Random(3)
    for _ in range(300):
        costs = [rng.choice([1, 3, 10, 40]) for _ in range(rng.randint(1, 25))]
        assert grouped.windows(costs, 30, 8) == slow_windows(costs, 30, 8)
    assert grouped.windows([], 30, 8) == []


def test_chunks_cover_every_segment(spark):
    rows = [("s", i, None, None, "word " * (i % 7 + 1), i * 40, i * 40 + 39) for i in range(60)]
    frame = spark.createDataFrame(rows, "source_id string, segment_index int, speaker string, start_ts string, text string, char_start int, char_end int")
    got = grouped.chunk_segments(frame, 60, 15).orderBy("chunk_index").collect()
    seen = set()
    for r in got:
        seen |= set(range(r["first_segment_index"], r["last_segment_index"] + 1))
        assert r["total"] == len(got)
    assert seen == set(range(60))


CANDIDATE = "source_id string, extraction_type string, key string, quote string, task string, owner string, confidence double, char_start int, char_end int"


def test_dedup_compares_with_survivors_only(spark):
    rows = [
        ("s", "action", "a", "q1", "write the launch report now", "Bo", 0.9, 0, 10),
        ("s", "action", "b", "q2", "write the launch report today", "Bo", 0.8, 500, 510),  # same owner
        ("s", "action", "c", "q1", "write launch report", "Al", 0.7, None, None),  # same quote
        ("s", "action", "d", "q9", "book the venue room", "UNSPECIFIED", 0.95, 40, 60),
        ("s", "action", "e", "q8", "book venue", "UNSPECIFIED", None, 45, 60),  # overlap
        ("s", "action", "f", "q7", "book venue", "UNSPECIFIED", 0.0, 900, 960),  # elsewhere, no owner
    ]
    got = {r["key"]: (r["survivor_key"], r["reason"]) for r in grouped.greedy_dedup(spark.createDataFrame(rows, CANDIDATE)).collect()}
    assert got == {"a": ("a", None), "b": ("a", "same_owner"), "c": ("a", "identical_quote"), "d": ("d", None), "e": ("d", "overlapping_span"), "f": ("f", None)}
    without = {r["key"]: r["survivor_key"] for r in grouped.greedy_dedup(spark.createDataFrame(rows, CANDIDATE), owner_rule=False).collect()}
    assert without["b"] == "b"


def test_pairing_prefers_quotes(spark):
    golden = spark.createDataFrame([("g", "g1", 0, "zzz", "fix login page bug"), ("g", "g2", 1, "exact words", "other thing")], "group_id string, golden_id string, position int, quote string, task string")
    told = spark.createDataFrame([("g", "e1", 0, "the exact words here", "fix login page bug")], "group_id string, extraction_id string, position int, quote string, task string")
    got = {(r["golden_id"], r["extraction_id"]) for r in grouped.greedy_pairs(golden, told).collect()}
    assert got == {("g2", "e1"), ("g1", None)}
    assert {(r["golden_id"], r["extraction_id"]) for r in grouped.greedy_pairs(golden.limit(0), told).collect()} == {(None, "e1")}
    assert {(r["golden_id"], r["extraction_id"]) for r in grouped.greedy_pairs(golden, told.limit(0)).collect()} == {("g1", None), ("g2", None)}
    scores = evaluation.recall_precision(grouped.greedy_pairs(golden, told)).first()
    assert (scores["recall"], scores["precision"]) == (0.5, 1.0)


EVENT = "extraction_id string, seq long, created_at timestamp, event_type string, actor string, override boolean, note string"


def test_review_machine(spark):
    own = spark.createDataFrame([("a", "pending", True), ("b", "pending", False), ("c", "pending", True)], "id string, status string, quote_verified boolean")
    at = lambda k: T0 + dt.timedelta(hours=k)
    events = [
        ("a", 1, at(1), "approved", " ", False, None), ("a", 2, at(2), "edited", "Ann", False, None), ("a", 3, at(3), "approved", "Ann", False, None), ("a", 4, at(4), "rejected", "Bo", False, None),
        ("b", 1, at(1), "approved", "Ann", False, "x"), ("b", 2, at(2), "approved", "Ann", True, " "), ("b", 3, at(3), "approved", "Ann", True, "seen"),
        ("z", 1, at(1), "approved", "Ann", False, None),
    ]
    frame = spark.createDataFrame(events, EVENT)
    problems = {(r["extraction_id"], r["seq"]): r["problem"] for r in review.judge_events(frame, own).collect()}
    assert problems == {("a", 1): "no_actor", ("a", 2): None, ("a", 3): None, ("a", 4): "not_pending", ("b", 1): "needs_override", ("b", 2): "needs_note", ("b", 3): None, ("z", 1): "unknown_extraction"}
    state = {r["id"]: (r["status"], r["reviewer"], r["edits"]) for r in review.fold_state(own, frame).collect()}
    assert state == {"a": ("approved", "Ann", 1), "b": ("approved", "Ann", 0), "c": ("pending", None, 0)}


def test_expiry_counts_the_boundary(spark):
    rows = [("a", "pending", T0), ("b", "pending", T0 + dt.timedelta(seconds=1)), ("c", "approved", T0)]
    frame = review.with_expiry(spark.createDataFrame(rows, "id string, status string, created_at timestamp"))
    after, events = review.expire_stale(frame, T0 + dt.timedelta(hours=72))
    assert {r["id"]: r["status"] for r in after.collect()} == {"a": "expired", "b": "pending", "c": "approved"}
    assert [r["extraction_id"] for r in events.collect()] == ["a"]


def test_rules(spark):
    rows = [("a", "approved", "Ann", T0, 0.5), ("b", "approved", " ", T0, 0.5), ("c", "pending", None, None, 1.5), ("d", "rejected", "Bo", None, None)]
    frame = spark.createDataFrame(rows, "id string, status string, reviewer string, reviewed_at timestamp, confidence double")
    good, bad = rules.check_rows(frame, "reviewer_named", "confidence_range")
    assert [r["id"] for r in good.collect()] == ["a"]
    assert {r["id"]: r["violations"] for r in bad.collect()} == {"b": ["reviewer_named"], "c": ["confidence_range"], "d": ["reviewer_named"]}
    with pytest.raises(rules.ReviewStateError):
        rules.strict(good, bad, "review")
    sources = spark.createDataFrame([("s", True), ("t", False), ("u", None)], "source_id string, consent_flag boolean")
    told = spark.createDataFrame([("1", "s"), ("2", "t"), ("3", "u"), ("4", "missing"), ("5", None)], "id string, source_id string")
    ok, refused = rules.consent_gate(told, sources)
    assert [r["id"] for r in ok.collect()] == ["1"] and refused.count() == 4


def test_writes_happen_once(spark):
    own = spark.createDataFrame([("a", "approved"), ("b", "pending"), ("c", "approved")], "id string, status string")
    asked = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1), ("x", 1)], "extraction_id string, seq int")
    done = spark.createDataFrame([("c", "MOCK-1")], "extraction_id string, external_ref string")
    got = {(r["extraction_id"], r["seq"]): r["outcome"] for r in tracker.write_outcomes(asked, own, done).collect()}
    assert got == {("a", 1): "created", ("a", 2): "deduplicated", ("b", 1): "blocked", ("c", 1): "deduplicated", ("x", 1): "blocked"}
    full = own.withColumns({"extraction_type": F.lit("action"), "payload": F.lit('{"what": "w", "owner": "UNSPECIFIED"}'), "quote_verified": F.lit(True), "verbatim_quote": F.lit("q"), "speaker": F.lit(None).cast("string"), "timestamp": F.lit(None).cast("string"), "source_id": F.lit("s")})
    new = tracker.sync_approved(full, done, first_number=2).collect()
    assert [(r["extraction_id"], r["external_ref"], r["assignee"]) for r in new] == [("a", "MOCK-2", None)]


def test_upsert_keeps_and_replaces(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert {(r["k"], r["v"]) for r in relational.upsert(old, new, "k").collect()} == {(1, "a"), (2, None), (3, "c")}
    assert {(r["k"], r["v"]) for r in relational.coalesce_update(old, new, "k").collect()} == {(1, "a"), (2, "b")}


def test_people(spark):
    rows = [("Priya Sharma", 1), ("priya", 2), ("Priya Menon", 3), ("Bo", 4), ("TBD", 5), (None, 6)]
    known = spark.createDataFrame([("Bo Li",), ("Ann Lee",)], "participant string")
    got = {r["person_key"]: r for r in rollups.person_groups(spark.createDataFrame(rows, "owner string, seq int"), known).collect()}
    assert got["priya"]["display_name"] == "Priya" and got["priya"]["ambiguous"] and got["priya"]["aliases"] == ["Priya Sharma", "priya", "Priya Menon"]
    assert got["bo"]["display_name"] == "Bo Li" and not got["bo"]["ambiguous"]
    assert got["unassigned"]["display_name"] == "Assignee unspecified" and got["unassigned"]["aliases"] == ["UNSPECIFIED"] and got["unassigned"]["n_items"] == 2


def test_signals(spark):
    messages = spark.createDataFrame([("1", "c", "2024-01-01", "a", "x"), ("2", "c", "2024-01-02", "b", "y"), ("3", "c", "2024-01-03", "b", "z")], "id string, channel string, ts string, author string, text string")
    labels = spark.createDataFrame([("1", "blocker", 0.9), ("2", "noise", 0.8), ("9", "noise", 0.1)], "message_id string, classification string, confidence double")
    assert {(r["message_id"], r["problem"]) for r in signals.answer_problems(messages, labels).collect()} == {("9", "unknown"), ("3", "missing")}
    known = signals.classify(messages, labels)
    assert sorted(r["id"] for r in signals.without_noise(known).collect()) == ["1", "3"]
    assert signals.run_counts(known).first().asDict() == {"messages_seen": 3, "classified": 2, "queued": 1, "noise_discarded": 1}
    assert signals.render_batches(signals.signal_batches(messages, 2)).count() == 2


def test_zero_denominators(spark):
    empty = spark.createDataFrame([], "golden_id string, extraction_id string")
    assert evaluation.recall_precision(empty).first()["recall"] == 0.0
    scores = {r["label"]: r for r in evaluation.class_scores(spark.createDataFrame([("a", None), ("b", "b")], "truth string, predicted string")).collect()}
    assert scores["a"]["precision"] is None and scores["a"]["recall"] == 0.0 and scores["noise"]["fp"] == 1
    told = evaluation.calibration(spark.createDataFrame([], "confidence double, correct boolean")).collect()
    assert len(told) == 5 and all(r["precision"] is None for r in told)
    assert evaluation.publishable("hashing", True, set(), set(), set(), set()) and evaluation.publishable("minilm", True, {"1"}, {"1"}, {"s"}, {"s"}) is None




def test_leaks_need_a_store(spark):
    some = spark.createDataFrame([("1",), ("2",)], "id string")
    assert evaluation.direct_message_leaks(some, some.where("id = '2'")).first().asDict() == {"stored": 2, "leaks": 1}
    assert evaluation.direct_message_leaks(some.limit(0), some).first().asDict() == {"stored": 0, "leaks": None}


def test_metrics_of_matched_items(spark):
    rows = [("Bo", "bo ", "2024-01-01", "2024-01-01", "absolute", "by x"), ("UNSPECIFIED", "UNSPECIFIED", "UNSPECIFIED", "2024-01-02", "relative_resolved", "soon"), ("Al", "Bo", "2024-01-01", "2024-01-03", "absolute", " ")]
    frame = spark.createDataFrame(rows, "golden_owner string, owner string, golden_due string, due_date string, date_type string, stated string")
    assert evaluation.owner_scores(frame).first().asDict() == {"named": 2, "named_right": 1, "unspecified": 1, "unspecified_kept": 1}
    assert evaluation.date_scores(frame).first().asDict() == {"invented": 2, "resolved": 1}
    risks = spark.createDataFrame([("high", "We will MISS it"), ("high", "fine"), ("low", "miss")], "severity string, quote string")
    assert evaluation.severity_defensible(risks).first().asDict() == {"high": 2, "defensible": 1}


def test_digest_prefers_attention(spark):
    rows = [
        ("c", "1", "risk", '{"severity": "medium"}', True, 0.9, 1, dt.date(2024, 1, 1)), ("c", "2", "risk", '{"severity": "high"}', True, 0.1, 2, dt.date(2024, 1, 2)), ("c", "3", "risk", '{"severity": "low"}', True, 0.9, 3, dt.date(2024, 1, 3)),
        ("c", "4", "action", '{"owner": "UNSPECIFIED", "due_date": "UNSPECIFIED"}', True, 0.9, 4, dt.date(2024, 1, 3)), ("c", "5", "signal", '{"classification": "request"}', True, 0.9, 5, dt.date(2024, 1, 2)),
    ]
    items = spark.createDataFrame(rows, "scope_key string, id string, extraction_type string, payload string, quote_verified boolean, confidence double, char_start int, approved_on date")
    told = lambda day: {r["id"]: (r["section"], r["position"]) for r in rollups.digest_sections(items, day).collect()}
    assert told(dt.date(2024, 1, 2)) == {"2": ("attention", 1), "1": ("attention", 2), "4": ("to_decide", 1), "5": ("moved", 1)}
    assert told(dt.date(2025, 1, 1)) == {"2": ("attention", 1), "1": ("attention", 2), "4": ("to_decide", 1), "3": ("moved", 1), "5": ("moved", 2)}


def test_records_and_recaps(spark):
    rows = [("1", "s", "action", '{"what": "w", "owner": "Bo", "due_date": "UNSPECIFIED"}', "{}", "q1", 3, "approved"), ("2", "s", "risk", '{"description": "d"}', '{"description": "d"}', "q2", 1, "approved"), ("3", "s", "action", "{}", "{}", "q", 1, "rejected"), ("4", "t", "action", "{}", "{}", "q", 1, "approved")]
    own = spark.createDataFrame(rows, "id string, source_id string, extraction_type string, payload string, original_payload string, verbatim_quote string, char_start int, status string")
    own = own.withColumns({"speaker": F.lit("Ann"), "timestamp": F.lit("00:01:00"), "confidence": F.lit(0.5)})
    sources = spark.createDataFrame([("s", "Title", True), ("t", "Other", False)], "source_id string, title string, consent_flag boolean").withColumns({"meeting_date": F.lit("2024-01-01").cast("date"), "participants": F.array(F.lit("Ann"))})
    approvals = spark.createDataFrame([("1", "Zoe", T0)], "extraction_id string, approved_by string, approved_at timestamp")
    got = rollups.outcome_records(own, sources, approvals).collect()
    assert [r["source_id"] for r in got] == ["s"] and got[0]["rejected_not_included"] == 1
    assert [(x["id"], x["approved_by"], x["edited_by_reviewer"]) for x in got[0]["actions"]] == [("1", "Zoe", True)] and not got[0]["risks"][0]["edited_by_reviewer"]
    body = {r["source_id"]: r["body"] for r in rollups.followup_drafts(own, sources).collect()}["s"]
    assert body.startswith("# Recap: Title\n\n_Meeting held 2024-01-01.") and "- w\n  Bo · no date stated\n  > \"q1\"\n  — Ann at 00:01:00" in body and body.index("committed") < body.index("Risks")


def test_digests_are_rendered(spark):
    lines = spark.createDataFrame([("c", "attention", 1, "late", "q", None, "00:01:00", "blocker"), ("c", "attention", 2, "x", "r", "Bo", None, "blocker")], "scope_key string, section string, position int, text string, quote string, speaker string, timestamp string, because string")
    scopes = spark.createDataFrame([("c", "#c"), ("d", "#d")], "scope_key string, scope_title string")
    got = {r["scope_key"]: r["markdown"] for r in rollups.render_digests(lines, scopes, "2024-01-02").collect()}
    assert got["d"].endswith("Nothing approved in scope for this day.")
    assert got["c"].startswith("# #c — 2024-01-02") and "_Nothing moved._" in got["c"] and '- late\n  > "q"\n  — unattributed at 00:01:00 · blocker\n- x' in got["c"]
    own = spark.createDataFrame([("bo", 1, "w", "q", "Ann", None, "Bo Li", "2024-02-01"), ("bo", 2, "v", "r", "Ann", None, "bo", "UNSPECIFIED")], "person_key string, position int, text string, quote string, speaker string, timestamp string, owner_as_stated string, due_date string")
    people = spark.createDataFrame([("bo", "Bo Li", ["Bo Li", "bo"], False), ("al", "Al", ["Al"], False)], "person_key string, display_name string, aliases array<string>, ambiguous boolean")
    told = {r["person_key"]: r["markdown"] for r in rollups.render_person_digests(own, people, "2024-01-02").collect()}
    assert list(told) == ["bo"] and told["bo"].index("With a date") < told["bo"].index("No date stated") and "due 2024-02-01, owner as stated: Bo Li" in told["bo"]
