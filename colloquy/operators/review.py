"""Review queue and its state machine, as a fold over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTL_HOURS = 72


def with_expiry(extractions: DataFrame, hours: int = TTL_HOURS) -> DataFrame:
    return extractions.withColumn("expires_at", F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(hours)))


def queue_order() -> list[Column]:
    """Unverified first, then the surest, then by place; ids make it total."""
    return [F.col("quote_verified").asc(), F.col("confidence").desc(), F.col("char_start").asc(), F.col("id").asc()]


def history_order() -> list[Column]:
    """Events as they happened."""
    return [F.col("created_at").asc(), F.col("seq").asc()]


def stale(extractions: DataFrame, now) -> DataFrame:
    """Pending extractions whose time has come; the boundary counts."""
    return extractions.where((F.col("status") == "pending") & F.col("expires_at").isNotNull() & (F.col("expires_at") <= F.lit(now)))


def expire_stale(extractions: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(extractions with stale ones expired, the events of it)."""
    due = (F.col("status") == "pending") & F.coalesce(F.col("expires_at") <= F.lit(now), F.lit(False))
    events = stale(extractions, now).select(
        F.col("id").alias("extraction_id"), F.lit("expired").alias("event_type"), F.lit("system").alias("actor"), F.lit("pending").alias("status_before"), F.lit("expired").alias("status_after"), F.lit(now).alias("created_at")
    )
    return extractions.withColumn("status", F.when(due, "expired").otherwise(F.col("status"))), events


def judge_events(events: DataFrame, extractions: DataFrame) -> DataFrame:
    """Events with ``problem``: null for one that may happen.

    Only pending items change; the first approval, rejection or expiry that is otherwise in order ends it.
    Approval and rejection need a name; an unverified quote needs an override and a note to be approved.
    """
    rows = events.join(extractions.select(F.col("id").alias("extraction_id"), "quote_verified"), "extraction_id", "left")
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    deciding = F.col("event_type").isin("approved", "rejected")
    unverified = (F.col("event_type") == "approved") & ~F.coalesce(F.col("quote_verified"), F.lit(False))
    own = (
        F.when(F.col("quote_verified").isNull(), "unknown_extraction")
        .when(deciding & blank("actor"), "no_actor")
        .when(unverified & ~F.coalesce(F.col("override"), F.lit(False)), "needs_override")
        .when(unverified & blank("note"), "needs_note")
    )
    rows = rows.withColumn("_own", own)
    ends = F.when(F.col("_own").isNull() & F.col("event_type").isin("approved", "rejected", "expired"), 1).otherwise(0)
    ended = F.coalesce(F.sum(ends).over(Window.partitionBy("extraction_id").orderBy("created_at", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("problem", F.when(ended > 0, "not_pending").otherwise(F.col("_own"))).drop("_own", "quote_verified")


def fold_state(extractions: DataFrame, events: DataFrame) -> DataFrame:
    """id, status, reviewer, edits of each extraction after the valid events."""
    valid = judge_events(events, extractions).where("problem is null")
    ending = F.when(F.col("event_type").isin("approved", "rejected", "expired"), F.struct("created_at", "seq", "event_type", "actor"))
    told = valid.groupBy("extraction_id").agg(F.min(ending).alias("end"), F.count_if(F.col("event_type") == "edited").alias("edits"))
    return extractions.join(told, F.col("id") == F.col("extraction_id"), "left").select(
        "id", F.coalesce("end.event_type", "status").alias("status"), F.col("end.actor").alias("reviewer"), F.coalesce("edits", F.lit(0)).alias("edits")
    )


def first_approvals(events: DataFrame) -> DataFrame:
    """extraction_id, approved_by, approved_at of the first approval."""
    first = F.min_by(F.struct("actor", "created_at"), F.struct("created_at", "seq"))
    return events.where("event_type = 'approved'").groupBy("extraction_id").agg(first.alias("f")).select("extraction_id", F.col("f.actor").alias("approved_by"), F.col("f.created_at").alias("approved_at"))


def summary(extractions: DataFrame) -> DataFrame:
    status = lambda s: F.count_if(F.col("status") == s).alias(s)
    return extractions.agg(*[status(s) for s in ("pending", "approved", "rejected", "expired")], F.count_if((F.col("status") == "pending") & ~F.col("quote_verified")).alias("unverified_pending"))
