import datetime as dt
import json

from colloquy.plans import extraction as ex
from colloquy.plans import ingest
from colloquy.sources import files

NOW = dt.datetime(2024, 11, 18, 18)
TALK = "[00:00:01] Ada Moss: We must ship the report by Friday.\n[00:00:05] Bo Li: I will write the launch report by Friday.\n[00:00:09] Ada Moss: Good, done.\n"


def manifest(spark, tmp_path):
    rows = [
        {"id": "ok", "title": "Sync", "source_type": "transcript", "date": "2024-11-18", "participants": ["Ada Moss", "Bo Li", "Cy Noh"], "consent_flag": True, "file_path": "ok.txt"},
        {"id": "cut", "title": "Cut", "source_type": "transcript", "date": "2024-11-18", "participants": [], "consent_flag": True, "file_path": "cut.txt"},
        {"id": "no", "title": "No", "source_type": "transcript", "consent_flag": False, "participants": [], "file_path": "ok.txt"},
        {"id": "gone", "title": "Gone", "source_type": "transcript", "consent_flag": True, "participants": [], "file_path": "gone.txt"},
        {"id": "chat", "title": "Chat", "source_type": "chat_export", "consent_flag": True, "participants": [], "file_path": "c.json"},
    ]
    root = tmp_path / "in"
    root.mkdir()
    (root / "ok.txt").write_text(TALK)
    (root / "cut.txt").write_text("[00:01] Ada Moss: Hi.\n[00:02] Ada Moss: We need to upd")
    (root / "c.json").write_text(json.dumps([{"id": "1", "channel": "dev", "text": "hi"}, {"id": "1", "channel": "dev", "text": "again"}, {"id": "2", "channel": "dm-a", "text": "psst"}]))
    (tmp_path / "m.json").write_text(json.dumps({"sources": rows}))
    return files.read_manifest(spark, str(tmp_path / "m.json")), str(root)


def test_ingest(spark, tmp_path):
    rows, root = manifest(spark, tmp_path)
    got = ingest.ingest_transcripts(spark, rows, root)
    status = {r["source_id"]: (r["status"], r["reason"]) for r in got.sources.collect()}
    assert status["ok"] == ("ingested", None) and status["no"][0] == "refused" and status["cut"][0] == status["gone"][0] == "error"
    assert status["cut"][1].startswith("truncated_mid_sentence at line 2") and status["gone"][1].startswith("empty_file: file does not exist")
    assert {r["source_id"] for r in got.segments.collect()} == {"ok"}
    report = {r["source_id"]: r for r in got.reports.collect()}["ok"]
    assert report["silent"] == ["Cy Noh"] and report["speakers"] == ["Ada Moss", "Bo Li"] and report["duration_seconds"] == 9.0
    again = ingest.ingest_transcripts(spark, rows, root, stored=got.sources)
    assert "ok" not in {r["source_id"] for r in again.sources.collect()}


def test_ingest_chat(spark, tmp_path):
    rows, root = manifest(spark, tmp_path)
    got = ingest.ingest_chats(spark, rows, root)
    assert [(r["id"], r["channel"]) for r in got.segments.collect()] == [("chat::1", "dev")]
    assert got.reports.first()["direct_messages_excluded"] == 1


def answer(prompt):
    if "refused" not in prompt:
        return '{"actions": [{"verbatim_quote": "I will write the lunch report", "what": "x"}]}'
    return """```json
{"actions": [
 {"what": "Write the launch report", "owner": "Bo Li", "due_date": "by Friday", "verbatim_quote": "I will write the launch report by Friday.", "confidence": 0.9},
 {"what": "write launch report", "owner": "Bo Li", "due_date": "n/a", "verbatim_quote": "We must ship the report", "confidence": 0.4}]}
```"""


def test_extraction(spark, tmp_path):
    rows, root = manifest(spark, tmp_path)
    got = ingest.ingest_transcripts(spark, rows, root)
    prompt = ex.parse_prompt("actions", "# version: 2\n---\nFind actions.")
    assert prompt.version_tag.startswith("2+") and len(prompt.version_tag) == 8
    requests = ex.chunk_requests(got.segments, got.sources, prompt)
    calls = ex.call_structured(requests, answer, ex.quotes_are_literal("actions"))
    assert [(r["attempt"], r["outcome"]) for r in ex.telemetry(calls, "actions").orderBy("attempt").collect()] == [(1, "quote_unverified"), (2, "ok")]
    done = ex.run_extraction(got.segments, got.sources, requests, calls, ex.ACTIONS, NOW)
    row = done.collect()
    assert len(row) == 1 and row[0]["quote_verified"] and row[0]["segment_id"] == "ok::seg0001" and row[0]["expires_at"] == NOW + dt.timedelta(hours=72)
    payload = json.loads(row[0]["payload"])
    assert (payload["owner"], payload["due_date"], payload["due_date_type"]) == ("Bo Li", "2024-11-22", "relative_resolved")
    assert ex.run_counts(done).first().asDict() == {"verified": 1, "unverified": 0, "unspecified_owner": 0, "unspecified_date": 0, "dates_resolved": 1}
    # a cached answer is not asked for again
    cache = spark.createDataFrame([(r["key"], r["response"]) for r in calls.collect()], "key string, response string")
    hits = ex.call_structured(requests, lambda p: 1 / 0, ex.quotes_are_literal("actions"), cache).collect()
    assert [r["cache_hit"] for r in hits] == [True]
    failed = ex.call_structured(requests, lambda p: "no json", ex.quotes_are_literal("actions"), retries=2).first()
    assert failed["response"] is None and [a["outcome"] for a in failed["attempts"]] == ["parse_error"] * 2


def test_replacing_keeps_what_is_decided(spark):
    old = spark.createDataFrame([("a", "s", "action", "pending"), ("b", "s", "action", "approved"), ("c", "t", "action", "pending"), ("d", "s", "risk", "pending")], "id string, source_id string, extraction_type string, status string")
    new = spark.createDataFrame([("e", "s", "action", "pending")], old.schema)
    assert sorted(r["id"] for r in ex.replace_pending(old, new).collect()) == ["b", "c", "d", "e"]


def test_proposals_need_quotes(spark):
    seg = spark.createDataFrame([("s", 0, "the launch moved")], "source_id string, segment_index int, text string")
    rows = [("s", "w", "launch  moved", " "), ("s", "w", "lunch", "Bo"), ("t", "w", "launch", "Bo")]
    good, bad = ex.propose_actions(spark.createDataFrame(rows, "source_id string, what string, quote string, owner string"), seg, NOW)
    row = good.first()
    assert good.count() == 1 and (row["char_start"], row["char_end"]) == (4, 16) and json.loads(row["payload"])["owner"] == "UNSPECIFIED"
    assert sorted(r["reason"] for r in bad.collect()) == ["no such source", "the quote is not in the source"]


def test_search_text_and_prompts():
    import pytest

    assert ex.parse_prompt("p", "only a body").version == "0"
    with pytest.raises(ValueError):
        ex.parse_prompt("p", "# version: 1\n---\n ")
