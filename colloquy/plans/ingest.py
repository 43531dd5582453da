"""Ingestion as one plan: consent, read, skip unchanged, parse, validate, normalise, report."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.relational import changed_only
from colloquy.operators.segments import normalise_segments, silent_participants, summarise_defects, validate_segments
from colloquy.sources import files

ROW = ["source_id", "title", "source_type", "meeting_date", "participants", "consent_flag", "file_path"]


@dataclass
class Ingested:
    """Sources with their status, segments of those that passed, and a report of each source that was read."""

    sources: DataFrame
    segments: DataFrame
    reports: DataFrame
    judged: DataFrame

    def release(self) -> None:
        """Let go of the parsed files that the three results are read from."""
        self.judged.unpersist()


def _read(spark: SparkSession, manifest: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(refused sources, readable ones with text, hash and defects).  A file that is not there is a defect."""
    allowed, refused = files.consented(manifest)
    base = re.escape(root.rstrip("/").removeprefix("file://"))
    stored = files.read_files(spark, root).withColumn("file_path", F.regexp_extract("path", rf"^(?:[a-z]+:/*)?{base.lstrip('/')}/(.*)$", 1))
    absent = F.array(files.defect("empty_file", "error", F.concat(F.lit("file does not exist: "), F.col("file_path"))))
    read = allowed.join(stored, "file_path", "left")
    return refused, read.withColumns({"text": F.coalesce("text", F.lit("")), "defects": F.coalesce("defects", absent), "path": F.coalesce("path", "file_path")})


def ingest_transcripts(spark: SparkSession, manifest: DataFrame, root: str, stored: DataFrame | None = None, check_truncation: bool = True) -> Ingested:
    """Transcripts of a manifest whose files lie under ``root``.

    Sources that withhold consent are refused before their text is parsed.  Sources that ``stored``
    (source_id, content_hash, status) has with the same bytes are left alone.
    """
    refused, read = _read(spark, manifest.where("source_type = 'transcript'"), root)
    if stored is not None:
        read = changed_only(read, stored, "source_id", "content_hash")
    parsed = validate_segments(files.parse_files(read), check_truncation)
    judged = parsed.withColumn("reason", summarise_defects(F.col("defects"))).withColumn("status", F.when(F.col("reason") == "", "ingested").otherwise("error"))
    # three results are read from it, and the optimizer need not look through it
    judged = judged.persist()
    passed = judged.where("status = 'ingested'")
    raw = passed.select("source_id", F.posexplode("segments").alias("segment_index", "s")).select("source_id", "segment_index", "s.*")
    segments = normalise_segments(raw)
    silent = silent_participants(passed.select("source_id", "participants"), segments)
    told = segments.groupBy("source_id").agg(F.count("*").alias("segments_parsed"), F.array_sort(F.collect_set("speaker")).alias("speakers"), F.max_by("start_seconds", F.when(F.col("start_seconds").isNotNull(), F.col("segment_index"))).alias("duration_seconds"))
    reports = judged.select("source_id", "status", "format", "bytes_read", "content_hash", "defects", "reason").join(told, "source_id", "left").join(silent, "source_id", "left")
    none = F.lit(None).cast("string")
    sources = judged.select(*ROW, "status", "content_hash", F.nullif("reason", F.lit("")).alias("reason")).unionByName(refused.select(*ROW, "status", none.alias("content_hash"), "reason"))
    return Ingested(sources, segments, reports, judged)


def ingest_chats(spark: SparkSession, manifest: DataFrame, root: str) -> Ingested:
    """Chat exports of a manifest; direct messages never leave the parser."""
    refused, read = _read(spark, manifest.where("source_type = 'chat_export'"), root)
    parsed = files.parse_chat_files(read).withColumn("reason", summarise_defects(F.col("defects")))
    judged = parsed.withColumn("status", F.when(F.col("reason") == "", "ingested").otherwise("error"))
    judged = judged.persist()
    messages = judged.where("status = 'ingested'").select("source_id", F.explode("messages").alias("m")).select("source_id", "m.*")
    # an id may occur in two exports: stored ids carry their source
    messages = messages.withColumn("id", F.concat_ws("::", "source_id", "id")).dropDuplicates(["id"])
    reports = judged.select("source_id", "status", "direct_messages_excluded", "dm_channels", F.size("messages").alias("n_messages"), "defects", "reason")
    none = F.lit(None).cast("string")
    sources = judged.select(*ROW, "status", "content_hash", F.nullif("reason", F.lit("")).alias("reason")).unionByName(refused.select(*ROW, "status", none.alias("content_hash"), "reason"))
    return Ingested(sources, messages, reports, judged)
