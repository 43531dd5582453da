"""Content-addressed web archive.

An archive has two tables.  ``payloads`` holds every distinct payload once, under its SHA-256, which
is verified against the bytes; ``headers`` holds the exact header block of every record.  Records are
put together again by a join on the digest.

A payload whose digest is surely met once is written by the task that read it; only those that a bitmap
of repeated digests cannot rule out, and of these only the rows that a bitmap of first records lets
through, are moved to have one copy chosen.

Cases: ids of any type are written percent-encoded and read back as what they were; null html is an empty payload; repeated page ids keep a record each, the first of equal ones
being decided by page_id alone; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import may_match, scratch_path

BASE32_DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 as 32 base-32 letters: four groups of 40 bits, each eight digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), BASE32_DIGITS, BASE32)


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(page_id.cast("string")), F.lit("")), F.lit(">"))


def header_block() -> Column:
    """WARC/1.1 record header; the columns it needs are those that write_archive() makes."""
    revisit = F.col("record_type") == "revisit"
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", _urn(F.col("page_id"))),
        _header("WARC-Target-URI", F.coalesce(F.regexp_replace("url", r"[\r\n]", ""), F.lit(""))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, _header("WARC-Refers-To", _urn(F.col("first_id")))).otherwise(""),
        F.when(revisit, _header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        _header("Content-Length", F.col("payload_bytes").cast("string")),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Write ``pages`` (page_id, url, html) as an archive under ``path``.

    Of records with equal payloads of at least ``min_revisit_bytes``, the one with the smallest page_id
    is the response and the others revisit it.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    records = pages.select("page_id", "url", payload.alias("payload")).withColumn("address", F.sha2("payload", 256))
    narrow = records.select(
        "page_id", "url", "address", F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"),
    )
    read = pages.sparkSession.read
    narrow.write.parquet(f"{path}/index")
    index = read.schema(narrow.schema).parquet(f"{path}/index")
    firsts = index.groupBy("address").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    firsts.write.parquet(f"{path}/firsts")
    firsts = read.schema(firsts.schema).parquet(f"{path}/firsts")
    typed = index.join(firsts, "address").withColumn(
        "record_type",
        F.when((F.col("payload_bytes") >= min_revisit_bytes) & (F.col("page_id") > F.col("first_id")), "revisit").otherwise("response"),
    )
    typed.select("page_id", "address", header_block().alias("header")).write.parquet(f"{path}/headers")
    _stored(records, firsts).write.parquet(f"{path}/payloads")


def _stored(records: DataFrame, firsts: DataFrame) -> DataFrame:
    """address and payload, one row for each address."""
    repeated = firsts.where("n > 1").select("address")
    marked = may_match(records, repeated, ["address"])
    alone = marked.where(~F.col("_maybe")).select("address", "payload")
    # the same bitmap picks the first records of the other addresses
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    chosen = may_match(firsts, repeated, ["address"]).where("_maybe").select(key("first_id").alias("key"), "address")
    others = marked.where("_maybe").select(key("page_id").alias("key"), "address", "payload")
    wanted = may_match(others, chosen, ["key", "address"]).where("_maybe").drop("_maybe").join(chosen.hint("merge"), ["key", "address"])
    # equal rows of one page id would store their payload twice
    return alone.unionByName(wanted.groupBy("key", "address").agg(F.any_value("payload").alias("payload")).select("address", "payload"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/headers")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads; one that does not match its address fails the read."""
    rows = spark.read.parquet(f"{path}/payloads")
    sound = F.assert_true(F.sha2("payload", 256) == F.col("address"), F.lit("payload does not match its digest"))
    return rows.where(sound.isNull())


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The original records: page_id, header, payload, record (header block, payload, two line ends)."""
    return (
        read_headers(spark, path)
        .join(read_payloads(spark, path), "address")
        .select("page_id", "header", "payload", F.concat(F.col("header").cast("binary"), F.col("payload"), F.lit(CRLF * 2).cast("binary")).alias("record"))
    )


def _field(name: str, pattern: str = r"([^\r]*)") -> Column:
    return F.regexp_extract("header", rf"\r\n{name}: {pattern}\r\n", 1)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """What the archive tells of every record: facts of stored payloads, taken once for each and joined
    to the parsed headers by address, so that no payload is moved."""
    facts = read_payloads(spark, path).select(
        "address", F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest")
    )
    headers = read_headers(spark, path)
    refers_to = F.url_decode(F.nullif(_field("WARC-Refers-To", "<urn:page:([^>]*)>"), F.lit("")))
    parsed = headers.select(
        F.col("page_id"), "address", _field("WARC-Type").alias("record_type"), _field("Content-Length").cast("long").alias("told_bytes"),
        _field("WARC-Payload-Digest", "sha1:([^\r]*)").alias("told_digest"), refers_to.cast(headers.schema["page_id"].dataType).alias("refers_to"),
    )
    agrees = F.assert_true((F.col("told_bytes") == F.col("payload_bytes")) & (F.col("told_digest") == F.col("payload_digest")), F.lit("header and payload disagree"))
    return (
        parsed.join(facts, "address")
        .where(agrees.isNull())
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    )


def archive_pages(pages: DataFrame, path: str | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to an archive and read its index back."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archive(pages, path, min_revisit_bytes)
    return read_index(spark, path)
