import datetime as dt

from pyspark.sql import functions as F

from colloquy.operators import followups, rollups, tracker

NOW = dt.datetime(2024, 1, 1)
REQUEST = "draft_id string, seq long, kind string, person string, body string, channel string"


def drafts(spark):
    return spark.createDataFrame([("a", "draft", "made"), ("b", "draft", "made"), ("c", "sent", "made"), ("d", "draft", "made")], "draft_id string, status string, body string")


def test_requests_are_judged(spark):
    requests = [
        ("a", 1, "edit", " Ada ", "one", None), ("a", 2, "edit", "Bo", "two", None), ("a", 3, "send", "Scheduler", None, "general"), ("a", 4, "send", "Ada", None, "general"),
        ("a", 5, "edit", "Ada", "late", None), ("a", 6, "send", "Bo", None, "general"), ("b", 1, "send", " ", None, "x"), ("b", 2, "edit", None, "x", None), ("c", 1, "edit", "Ada", "x", None), ("z", 1, "edit", "Ada", "x", None),
    ]
    frame = spark.createDataFrame(requests, REQUEST)
    problems = {(r["draft_id"], r["seq"]): r["problem"] for r in followups.judge_requests(frame, drafts(spark)).collect()}
    assert problems == {("a", 1): None, ("a", 2): None, ("a", 3): "a_service", ("a", 4): None, ("a", 5): "already_sent", ("a", 6): "already_sent", ("b", 1): "nobody_named", ("b", 2): "nobody_named", ("c", 1): "already_sent", ("z", 1): "unknown_draft"}
    got = {r["draft_id"]: (r["status"], r["edited_by"], r["sent_by"], r["channel"], r["t"]) for r in followups.apply_requests(drafts(spark), frame).withColumn("t", followups.text_to_send()).collect()}
    assert got == {"a": ("sent", "Bo", "Ada", "general", "two"), "b": ("draft", None, None, None, "made"), "c": ("sent", None, None, None, "made"), "d": ("draft", None, None, None, "made")}


def test_versions_of_drafts(spark):
    new = spark.createDataFrame([("s", "Recap", "x", "draft"), ("t", "Recap", "y", "draft")], "source_id string, subject string, body string, status string")
    stored = spark.createDataFrame([("s", 1), ("s", 2)], "source_id string, draft_version int")
    got = {r["source_id"]: (r["draft_version"], r["draft_id"], r["status"]) for r in followups.insert_versions(new, stored, NOW).collect()}
    assert got == {"s": (3, "s::draft::3", "draft"), "t": (1, "t::draft::1", "draft")}


def test_backlog_and_compensation(spark):
    items = spark.createDataFrame([("M-1", "e1", False), ("M-2", "e2", False), ("OLD-1", None, True)], "external_ref string, source_ref string, seeded boolean")
    again = tracker.seed_backlog(items, spark.createDataFrame([("OLD-2",)], "external_ref string"))
    assert {r["external_ref"] for r in again.collect()} == {"M-1", "M-2", "OLD-2"}
    kept, lost = tracker.undo_unrecorded(again, spark.createDataFrame([("M-1",)], "external_ref string"))
    assert {r["external_ref"] for r in kept.collect()} == {"M-1", "OLD-2"} and [r["external_ref"] for r in lost.collect()] == ["M-2"]


def test_names_in_compatibility_form(spark):
    owners = spark.createDataFrame([("Ａｄａ Moss", 1), ("Ada", 2)], "owner string, seq long")
    assert [r["person_key"] for r in rollups.person_groups(owners).collect()] == ["ada"]


def test_records_are_loaded_by_version(spark):
    records = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("t", 9, "c")], "source_id string, record_version int, record string")
    assert rollups.load_record(records, "s").first()["record"] == "b" and rollups.load_record(records, "s", 1).first()["record"] == "a"
    assert [r["record"] for r in records.orderBy(*rollups.record_order()).collect()] == ["b", "a", "c"]


def test_embeddings_do_not_depend_on_their_batch(spark):
    import numpy as np

    from colloquy.functions import vectors

    texts = ["one two three two", "", None, "two three", "one two three two"]
    together = vectors.hash_embeddings(texts)
    assert all((together[k] == vectors.hash_embedding(t)).all() for k, t in enumerate(texts))
    assert np.allclose((together**2).sum(axis=1), [1, 0, 0, 1, 1])
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(vectors.hashing_embedder("t").alias("e"), F.col("t")).collect()
    assert all(np.allclose(r["e"], vectors.hash_embedding(r["t"])) for r in rows)
