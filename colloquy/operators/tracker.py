"""Tracker drafts, gated and idempotent writes, attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import UNSPECIFIED


def _field(key: str, missing: str = UNSPECIFIED) -> Column:
    return F.coalesce(F.get_json_object("payload", f"$.{key}"), F.lit(missing))


def build_drafts(extractions: DataFrame) -> DataFrame:
    """Tracker drafts of extractions; UNSPECIFIED owner or date becomes null, and a label says so."""
    owner, due, what = _field("owner"), _field("due_date"), F.get_json_object("payload", "$.what")
    timing = F.get_json_object("payload", "$.due_date_stated")
    no_owner, no_date, doubtful = owner == UNSPECIFIED, due == UNSPECIFIED, ~F.coalesce(F.col("quote_verified"), F.lit(False))
    lines = F.array_compact(
        F.array(
            F.coalesce(what, F.lit("")), F.lit(""),
            F.concat(F.lit('Quoted from the meeting: "'), F.col("verbatim_quote"), F.lit('"')),
            F.concat(F.lit("Said by: "), F.coalesce("speaker", F.lit("not attributed"))),
            F.concat(F.lit("At: "), F.coalesce("timestamp", F.lit("no timestamp"))),
            F.concat(F.lit("Source: "), F.col("source_id")), F.concat(F.lit("Extraction: "), F.col("id")),
            F.when(timing != "", F.concat(F.lit('Stated timing: "'), timing, F.lit('" -> '), due, F.lit(" ("), _field("due_date_rule", ""), F.lit(")"))),
            F.when(no_owner, F.lit("Owner: UNSPECIFIED, nobody was named.")),
            F.when(doubtful, F.lit("WARNING: the quote is no literal part of the transcript and was approved by override.")),
        )
    )
    labels = F.array_compact(F.array(F.lit("meeting-agent"), F.col("extraction_type"), F.when(no_owner, F.lit("needs-owner")), F.when(no_date, F.lit("needs-date")), F.when(doubtful, F.lit("unverified-quote"))))
    return extractions.select(
        F.col("id").alias("source_ref"), F.substring(F.coalesce(what, F.lit("Untitled action")), 1, 120).alias("title"), F.array_join(lines, "\n").alias("description"),
        F.nullif(owner, F.lit(UNSPECIFIED)).alias("assignee"), F.nullif(due, F.lit(UNSPECIFIED)).alias("due_date"), labels.alias("labels"),
    )


def write_outcomes(requests: DataFrame, extractions: DataFrame, writes: DataFrame) -> DataFrame:
    """What becomes of each request (extraction_id, seq): blocked, deduplicated or created.

    Only approved extractions pass; one that has a write, or an earlier request in this call, is not
    written again.
    """
    status = extractions.select(F.col("id").alias("extraction_id"), "status")
    done = writes.select("extraction_id", "external_ref")
    rows = requests.join(status, "extraction_id", "left").join(done, "extraction_id", "left")
    nth = F.row_number().over(Window.partitionBy("extraction_id").orderBy("seq"))
    outcome = F.when(~F.col("status").eqNullSafe("approved"), "blocked").when(F.col("external_ref").isNotNull() | (nth > 1), "deduplicated").otherwise("created")
    return rows.withColumn("outcome", outcome)


def sync_approved(extractions: DataFrame, writes: DataFrame, first_number: int = 1, prefix: str = "MOCK") -> DataFrame:
    """New writes (extraction_id, external_ref and the draft) of approved actions that have none.

    References are numbered without bringing all rows to one task: counts of hash buckets give each its
    first number.
    """
    new = extractions.where("status = 'approved' and extraction_type = 'action'").join(writes.select(F.col("extraction_id").alias("id")), "id", "left_anti")
    drafts = build_drafts(new).withColumn("_b", F.pmod(F.xxhash64("source_ref"), F.lit(64)))
    within = F.row_number().over(Window.partitionBy("_b").orderBy("source_ref"))
    sizes = drafts.groupBy("_b").agg(F.count("*").alias("_n"))
    # 64 rows at most
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = drafts.withColumn("_k", within).join(F.broadcast(sizes.select("_b", before.alias("_before"))), "_b")
    return numbered.withColumn("external_ref", F.concat(F.lit(f"{prefix}-"), (F.col("_before") + F.col("_k") + first_number - 1).cast("string"))).withColumnRenamed("source_ref", "extraction_id").drop("_b", "_k", "_before")


def seed_backlog(items: DataFrame, backlog: DataFrame) -> DataFrame:
    """``items`` with the rows that were seeded replaced by a backlog; they have no source_ref and come beside what was written."""
    kept = items.where(~F.coalesce("seeded", F.lit(False)))
    new = backlog.withColumns({"source_ref": F.lit(None).cast("string"), "seeded": F.lit(True)})
    return kept.unionByName(new, allowMissingColumns=True)


def undo_unrecorded(items: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items that stay, items taken back): one that was created for an extraction, but of which no write is recorded,
    goes again, as tracker and audit cannot share a transaction."""
    recorded = writes.select("external_ref").distinct()
    own = F.col("source_ref").isNotNull()
    lost = items.where(own).join(recorded, "external_ref", "left_anti")
    return items.join(lost.select("external_ref"), "external_ref", "left_anti"), lost


def tracker_order() -> list[Column]:
    return [F.col("created_at").asc(), F.col("external_ref").asc()]


def attempts(outcomes: DataFrame, provider: str, now) -> DataFrame:
    """Append-only rows of every attempt."""
    reason = F.when(F.col("outcome") == "blocked", F.concat(F.lit("status is "), F.coalesce("status", F.lit("missing")))).when(F.col("outcome") == "deduplicated", F.lit("already written"))
    return outcomes.select("extraction_id", "outcome", F.lit(provider).alias("provider"), "external_ref", reason.alias("reason"), F.lit(now).alias("attempted_at"))
