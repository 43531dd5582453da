import base64
import hashlib

from colloquy.llm import warc

ROWS = [
    (1, "http://a/", "same"), (2, "http://b/", "same"), (5, None, "same"), (3, "http://c/\r\nx", None), (4, "http://d/", ""), (6, "http://e/", "é😀" * 5000), (7, "u", "one"), (7, "u", "one"), (None, "u", "same"), (None, "v", "alone"),
]
SCHEMA = "page_id long, url string, html string, payload string, address string, header string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "a", "h") for r in rows], SCHEMA)


def test_index(spark):
    got = warc.archive_pages(frame(spark, ROWS))
    rows = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got.collect()), key=str)
    want = []
    for p, _, html in ROWS:
        body = (html or "").encode()
        first = min((q for q, _, h in ROWS if (h or "") == (html or "") and q is not None), default=None)
        kind = "revisit" if p is not None and first is not None and p > first else "response"
        want.append((p, kind, first if kind == "revisit" else None, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()))
    assert rows == sorted(want, key=str)


def test_small_payloads_may_stay_responses(spark):
    got = {r["page_id"]: r["record_type"] for r in warc.archive_pages(frame(spark, ROWS[:3]), min_revisit_bytes=5).collect()}
    assert set(got.values()) == {"response"}


def test_records_come_back_whole(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    warc.write_archive(frame(spark, ROWS), path)
    assert warc.read_payloads(spark, path).count() == len({h or "" for _, _, h in ROWS})
    records = warc.read_records(spark, path).collect()
    assert sorted((bytes(r["payload"]) for r in records)) == sorted((h or "").encode() for _, _, h in ROWS)
    for r in records:
        head, body = bytes(r["record"]).split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\n") and body == bytes(r["payload"]) + b"\r\n\r\n"
        assert f"Content-Length: {len(r['payload'])}".encode() in head


def test_a_damaged_payload_is_noticed(spark, tmp_path):
    import pytest

    path = f"file://{tmp_path}/b"
    warc.write_archive(frame(spark, ROWS[:2]), path)
    from pyspark.sql import functions as F

    warc.read_payloads(spark, path).withColumn("payload", F.lit("other").cast("binary")).write.mode("append").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="digest"):
        warc.read_index(spark, path).collect()


def test_empty(spark):
    assert warc.archive_pages(frame(spark, [])).count() == 0


def test_ids_of_any_type(spark):
    rows = [("a b>\r\n", "u", "same"), ("b/é", "u", "same"), ("b/é", "u", "same"), ("c", "u", "own"), (None, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages).collect()), key=str)
    want = [("a b>\r\n", "response", None), ("b/é", "revisit", "a b>\r\n"), ("b/é", "revisit", "a b>\r\n"), ("c", "response", None), (None, "response", None)]
    assert got == sorted(want, key=str)


def test_every_payload_is_stored_once(spark, tmp_path):
    """Many unique payloads, groups of copies, and repeated rows of one id."""
    rows = [(k, "u", f"own {k}") for k in range(300)] + [(1000 + k, "u", f"group {k % 7}") for k in range(200)] + [(2000, "u", "twice")] * 2
    path = f"file://{tmp_path}/c"
    warc.write_archive(frame(spark, rows), path)
    stored = [bytes(r["payload"]).decode() for r in warc.read_payloads(spark, path).collect()]
    assert sorted(stored) == sorted({html for *_, html in rows})
    assert warc.read_records(spark, path).count() == len(rows)
