import sqlite3

from pyspark.sql import functions as F

from colloquy.plans import retrieval as ret

TEXTS = [
    "We deferred the API launch until the audit", "It's the deference of the team that counts", "The apis and the API gateway are slow", "Launch launch launch",
    "Nobody owns the gateway", "Défère the launch", "", "What's up with the audit's scope", "it s a match", "The scope of auditing grew: api-first",
]
QUESTIONS = ["When did we defer the launch?", "audit scope", "who owns the API gateway", "it's", "the of and", "zzz", "launching audits"]


def fts(question):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize = 'porter unicode61')")
    con.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(TEXTS, 1)))
    words = ret.query_words(question)
    match = " OR ".join(f'"{w}"*' for w in words)
    return {r: -s for r, s in con.execute("select rowid, bm25(t) from t where t match ?", (match,))}


def test_bm25_is_that_of_a_full_text_index(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS, 1)), "id int, text string")
    for q in QUESTIONS:
        got = {r["id"]: r["keyword_score"] for r in ret.bm25(docs, ret.query_phrases(q)).collect()}
        want = fts(q)
        assert got.keys() == want.keys(), q
        assert all(abs(got[k] - want[k]) < 1e-6 for k in got), q


def test_scope_narrows_rows_and_not_statistics(spark):
    docs = spark.createDataFrame([(i, t, "a" if i % 2 else "b") for i, t in enumerate(TEXTS, 1)], "id int, text string, source_id string")
    phrases = ret.query_phrases("audit scope")
    every = {r["id"]: r["keyword_score"] for r in ret.bm25(docs, phrases).collect()}
    some = {r["id"]: r["keyword_score"] for r in ret.bm25(docs, phrases, scope=F.col("source_id") == "a").collect()}
    assert some == {k: v for k, v in every.items() if k % 2}


def frames(spark):
    seg = spark.createDataFrame([("s", i, f"s::seg{i:04d}", t) for i, t in enumerate(TEXTS)], "source_id string, segment_index int, segment_id string, text string")
    ext = spark.createDataFrame([("e1", "s", "approved", '{"what": "plan the launch"}', "launch"), ("e2", "s", "pending", '{"what": "launch"}', "launch")], "id string, source_id string, status string, payload string, verbatim_quote string")
    vec = spark.createDataFrame([("segment", "s::seg0003", "s", [1.0, 0.0]), ("segment", "s::seg0004", "s", [0.6, 0.8]), ("extraction", "e1", "s", [0.0, 1.0])], "ref_type string, ref_id string, source_id string, embedding array<double>")
    return seg, ext, vec


def test_search_modes(spark):
    seg, ext, vec = frames(spark)
    keyword = ret.keyword_search(seg, ext, "launch", 5)
    assert "e2" not in {r["ref_id"] for r in keyword.collect()}
    assert sorted(r["keyword_rank"] for r in keyword.collect()) == list(range(1, keyword.count() + 1))
    dense = ret.dense_search(vec, [1.0, 0.0], 2).collect()
    assert [(r["ref_id"], r["dense_rank"]) for r in sorted(dense, key=lambda r: r["dense_rank"])] == [("s::seg0003", 1), ("s::seg0004", 2)]
    hits = ret.search(seg, ext, vec, "launch", [1.0, 0.0], "hybrid", limit=3, window=1).collect()
    ranked = [r for r in hits if not r["is_neighbour"]]
    assert len(ranked) == 3 and min(ranked, key=lambda r: r["position"])["ref_id"] == "s::seg0003"
    assert max(r["position"] for r in ranked) < min(r["position"] for r in hits if r["is_neighbour"])
    assert ret.search(seg, ext, vec, "launch", [1.0, 0.0], "dense", limit=1, window=0).count() == 1


def test_fusion_scores(spark):
    kw = spark.createDataFrame([("segment", "a", "s", 1, 2.0), ("segment", "b", "s", 2, 1.0)], "ref_type string, ref_id string, source_id string, keyword_rank int, keyword_score double")
    dn = spark.createDataFrame([("segment", "b", "s", 1, 0.9), ("segment", "c", "s", 2, 0.8)], "ref_type string, ref_id string, source_id string, dense_rank int, dense_score double")
    got = {r["ref_id"]: (r["rank"], r["found_by"], r["score"]) for r in ret.reciprocal_rank_fusion(kw, dn).collect()}
    assert got["b"] == (1, "both", 1 / 62 + 1 / 61) and got["a"][:2] == (2, "keyword") and got["c"][:2] == (3, "dense")


def test_answers_need_their_own_source(spark):
    hits = spark.createDataFrame([(1, "the launch moved"), (2, "nobody knows")], "position int, text string")
    claims = spark.createDataFrame([(1, "launch moved", "x"), (2, "launch moved", "x"), (3, "nobody", "x"), (1, " ", "x")], "source_number int, quote string, text string")
    assert [r["source_number"] for r in ret.verified_claims(claims, hits).collect()] == [1]
    assert ret.answer(claims, hits).first().asDict() == {"found": True, "kept": 1, "dropped": 3}


def test_chat_search_needs_all_words(spark):
    rows = spark.createDataFrame([("1", "dev", "the launch slipped"), ("2", "dev", "launch"), ("3", "ops", "slipping launches")], "id string, channel string, text string")
    assert sorted(r["ref_id"] for r in ret.chat_search(rows, "launch slip").collect()) == ["1", "3"]
    assert [r["ref_id"] for r in ret.chat_search(rows, "launch slip", scope=["ops"]).collect()] == ["3"]


def test_index_round_trip(spark, tmp_path):
    seg, ext, _ = frames(spark)
    texts = ret.indexable(seg, spark.createDataFrame([("s", True)], "source_id string, consent_flag boolean"), ext)
    path = str(tmp_path / "index")
    ret.build_index(texts, path)
    index = ret.load_index(spark, path, len(TEXTS) + 1)
    assert all(r["built_at"] for r in ret.index_stats(index).collect())
    assert {r["ref_type"]: r["n"] for r in ret.index_stats(index).collect()} == {"segment": len(TEXTS), "extraction": 1}
    changed = texts.withColumn("text", F.when(F.col("ref_id") == "e1", "new").otherwise(F.col("text")))
    assert [r["ref_id"] for r in ret.stale_vectors(changed, index).collect()] == ["e1"]


def test_postings_tell_what_bm25_tells(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS, 1)), "id int, text string")
    path = str(tmp_path / "postings")
    ret.build_postings(docs, path)
    for q in QUESTIONS:
        got = {r["id"]: r["keyword_score"] for r in ret.search_postings(spark, path, ret.query_phrases(q)).collect()}
        want = fts(q)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got), q


def citable(spark):
    seg, ext, _ = frames(spark)
    none = F.lit(None).cast("string")
    seg = seg.withColumns({"speaker": F.lit("Ada"), "start_ts": F.lit("00:00:01"), "char_start": F.lit(0), "char_end": F.lit(5)})
    ext = ext.withColumns({"extraction_type": F.lit("action"), "quote_verified": F.lit(True), "speaker": none, "timestamp": none, "char_start": F.lit(0), "char_end": F.lit(6)})
    sources = spark.createDataFrame([("s", "The meeting", True, "transcript", "ingested", None), ("t", "Another", False, "transcript", "refused", None)], "source_id string, title string, consent_flag boolean, source_type string, status string, meeting_date date")
    return seg, ext, sources


def test_hits_are_hydrated_or_dropped(spark):
    seg, ext, sources = citable(spark)
    hits = spark.createDataFrame([("segment", "s::seg0003", 1), ("extraction", "e1", 2), ("extraction", "e2", 3), ("segment", "nowhere", 4)], "ref_type string, ref_id string, rank int")
    got = {r["rank"]: (r["title"], r["text"], r["speaker"]) for r in ret.hydrate(hits, seg, ext, sources).collect()}
    assert got == {1: ("The meeting", TEXTS[3], "Ada"), 2: ("The meeting", "launch", None)}
    refused = sources.withColumn("consent_flag", F.lit(False))
    assert {r["ref_type"] for r in ret.keyword_search(seg, ext, "launch", 9, sources=refused).collect()} == {"extraction"}


def test_hybrid_search_agrees_with_both_halves_fused_by_hand(spark, tmp_path):
    import numpy as np

    from colloquy.functions.vectors import hash_embedding

    seg, ext, sources = citable(spark)
    path, question = str(tmp_path / "v"), "launch of the gateway"
    ret.build_index(ret.indexable(seg, sources, ext), path)
    asked = hash_embedding(question)
    got = ret.search(seg, ext, ret.load_index(spark, path), question, [float(x) for x in asked], limit=4, window=0).orderBy("position").collect()
    texts = [("segment", f"s::seg{i:04d}", t) for i, t in enumerate(TEXTS)] + [("extraction", "e1", "plan the launch launch")]
    dense = sorted(texts, key=lambda r: (-round(float(np.dot(hash_embedding(r[2]).astype(float), asked.astype(float))), 12), r[0] != "segment", r[1]))[:12]
    keyword = [(r["ref_type"], r["ref_id"]) for r in ret.keyword_search(seg, ext, question, 12).orderBy("keyword_rank").collect()]
    score = {}
    for ranking in (keyword, [r[:2] for r in dense]):
        for k, ref in enumerate(ranking, 1):
            score[ref] = score.get(ref, 0) + 1 / (60 + k)
    place = {ref: k for k, ref in enumerate(keyword)}
    want = sorted(score, key=lambda ref: (-score[ref], place.get(ref, 99)))[:4]
    assert [(r["ref_type"], r["ref_id"]) for r in got] == want


def test_tools_stay_inside_their_scope(spark):
    import pytest

    from colloquy.plans import agent

    seg, ext, sources = citable(spark)
    messages = spark.createDataFrame([("m1", "s", "dev", "bo", "1", "the launch slipped", "blocker"), ("m2", "t", "dev", "al", "2", "launch", None)], "id string, source_id string, channel string, author string, ts string, text string, classification string")
    items = spark.createDataFrame([("MOCK-1", None, "open", "x")], "external_ref string, assignee string, status string, title string")
    tools = agent.Toolbelt(sources, seg, ext, messages, items, frozenset({"s"}))
    assert [r["source_id"] for r in tools.list_sources().collect()] == ["s"]
    assert [r["id"] for r in tools.read_chat().collect()] == ["m1"] and tools.search_chat("launch").count() == 1
    assert [r["segment_index"] for r in tools.read_transcript("s", 2, 3).orderBy("segment_index").collect()] == [2, 3, 4]
    assert {r["id"] for r in tools.list_extractions(status="approved").collect()} == {"e1"}
    for outside in (lambda: tools.read_transcript("t"), lambda: tools.focus_on("t"), lambda: tools.list_extractions("t")):
        with pytest.raises(agent.OutOfScope):
            outside()
    free = agent.Toolbelt(sources, seg, ext, messages, items)
    free.focus_on("t")
    assert [r["id"] for r in free.read_chat().collect()] == ["m2"] and free.search_transcripts("launch").count() == 0
    free.focus_on("")
    assert free.read_chat().count() == 2
    with pytest.raises(agent.OutOfScope):
        free.focus_on("nowhere")
    claims = spark.createDataFrame([(1, "launch launch", "x"), (1, "not there", "x")], "source_number int, quote string, text string")
    assert [r["quote"] for r in tools.answer(claims, "launch").collect()] == ["launch launch"]
    assert agent.observe(tools.list_tracker(), F.col("external_ref")) == "MOCK-1 | unassigned | open | x"
    assert agent.observe(seg.select(F.repeat("text", F.lit(300)).alias("line")), F.col("line"), most=50).endswith("characters more)")
    pending, refused = tools.propose(spark.createDataFrame([("s", "plan", "launch launch", ""), ("t", "x", "y", "")], "source_id string, what string, quote string, owner string"), __import__("datetime").datetime(2024, 1, 1))
    assert pending.count() == 0 or pending.count() == 1
    assert refused.where("source_id = 't'").count() == 1
