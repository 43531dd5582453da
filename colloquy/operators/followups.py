"""Follow-up drafts after they are made: versions, a person's edits, and sending by a person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.relational import next_version
from colloquy.operators.rules import SERVICE_NAMES


def insert_versions(new: DataFrame, stored: DataFrame, now) -> DataFrame:
    """New drafts (source_id, subject, body, ...) under the next version of their source, born as drafts."""
    versions = next_version(stored, "source_id", "draft_version").withColumnRenamed("next_version", "_next")
    rows = new.drop("status").join(versions, "source_id", "left").withColumn("draft_version", F.coalesce("_next", F.lit(1)).cast("int")).drop("_next")
    return rows.select("*", F.concat_ws("::", "source_id", F.lit("draft"), F.col("draft_version").cast("string")).alias("draft_id"), F.lit("draft").alias("status"), F.lit(now).alias("generated_at"))


def _named(person: Column) -> Column:
    return F.coalesce(F.trim(person), F.lit("")) != ""


def judge_requests(requests: DataFrame, drafts: DataFrame) -> DataFrame:
    """Requests (draft_id, seq, kind: edit or send, person) with ``problem``; null for one that may happen.

    An edit names its person; a message is sent by a person, not a service, and once.  After it is sent a
    draft does not change.
    """
    state = drafts.select("draft_id", (F.col("status") == "sent").alias("_sent"))
    rows = requests.join(state, "draft_id", "left")
    sends = F.col("kind") == "send"
    own = (
        F.when(F.col("_sent").isNull(), "unknown_draft").when(~_named(F.col("person")), "nobody_named")
        .when(sends & F.lower(F.trim("person")).isin(SERVICE_NAMES), "a_service").when(F.col("_sent"), "already_sent")
    )
    rows = rows.withColumn("_own", own)
    earlier = Window.partitionBy("draft_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.max(sends & F.col("_own").isNull()).over(earlier), F.lit(False))
    return rows.withColumn("problem", F.when(F.col("_own").isNull() & gone, "already_sent").otherwise(F.col("_own"))).drop("_own", "_sent")


def apply_requests(drafts: DataFrame, requests: DataFrame) -> DataFrame:
    """``drafts`` with status, edited_body, edited_by, sent_by and channel after the valid requests (..., body, channel).

    What was generated stays as it was.
    """
    valid = judge_requests(requests, drafts).where("problem is null")
    edits = F.when(F.col("kind") == "edit", F.struct("seq", "body", F.trim("person").alias("person")))
    sends = F.when(F.col("kind") == "send", F.struct("seq", F.trim("person").alias("person"), "channel"))
    told = valid.groupBy("draft_id").agg(F.max(edits).alias("edit"), F.max(sends).alias("send"))
    status = F.when(F.col("send").isNotNull(), "sent").when(F.col("edit").isNotNull(), "edited").otherwise(F.col("status"))
    return drafts.join(told, "draft_id", "left").select(
        *[c for c in drafts.columns if c != "status"], status.alias("status"), F.col("edit.body").alias("edited_body"), F.col("edit.person").alias("edited_by"),
        F.col("send.person").alias("sent_by"), F.col("send.channel").alias("channel"),
    )


def text_to_send() -> Column:
    """What a person has in front of them: their edit, or the draft."""
    return F.coalesce("edited_body", "body")


def draft_order() -> list[Column]:
    return [F.col("generated_at").desc(), F.col("draft_version").desc(), F.col("source_id").asc()]
