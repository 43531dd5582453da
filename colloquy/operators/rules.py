"""Integrity rules as validating transforms: accepted rows, and violations with the rule's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.schemas import TERMINAL_STATUS

# Names that are a service's and no person's.
SERVICE_NAMES = ["agent", "system", "scheduler", "bot", "service", "llm", "model"]


class RuleViolation(ValueError):
    """Base of the errors that a strict writer raises."""


class ConsentRefused(RuleViolation):
    pass


class ApprovalGateViolation(RuleViolation):
    pass


class ReviewStateError(RuleViolation):
    pass


class AppendOnlyViolation(RuleViolation):
    pass


ERRORS = {"consent": ConsentRefused, "gate": ApprovalGateViolation, "review": ReviewStateError, "append_only": AppendOnlyViolation}


def typed_error(message: str) -> RuleViolation:
    """The error that a message's prefix, up to its colon, stands for."""
    return ERRORS.get(message.partition(":")[0].strip(), RuleViolation)(message)


#: Rules on single rows: name -> what must hold.
ROW_RULES: dict[str, Column] = {}


def _rules() -> dict[str, Column]:
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    return {
        "source_reason": ~F.col("status").isin("refused", "error") | ~blank("reason"),
        "reviewer_named": ~F.col("status").isin("approved", "rejected") | (~blank("reviewer") & F.col("reviewed_at").isNotNull()),
        "no_direct_message": ~F.coalesce(F.col("is_direct_message"), F.lit(False)),
        "no_noise": ~F.col("classification").eqNullSafe("noise"),
        "confidence_range": F.col("confidence").isNull() | F.col("confidence").between(0, 1),
        "person_sends": (F.col("status") != "sent") | (~blank("sent_by") & ~F.lower(F.trim(F.col("sent_by"))).isin(SERVICE_NAMES)),
        "born_draft": F.col("status") == "draft",
    }


def check_rows(df: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, violations) under rules on single rows; a null outcome is a violation."""
    rules = _rules()
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(rules[n], F.lit(False)), F.lit(n)) for n in names]))
    judged = df.withColumn("violations", failed)
    return judged.where(F.size("violations") == 0).drop("violations"), judged.where(F.size("violations") > 0)


def consent_gate(extractions: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extractions of consenting sources; a missing source, or unknown consent, refuses too."""
    agreed = sources.where(F.col("consent_flag").eqNullSafe(True)).select("source_id").distinct()
    return extractions.join(agreed, "source_id", "left_semi"), extractions.join(agreed, "source_id", "left_anti").withColumn("violations", F.array(F.lit("consent")))


def approval_gate(writes: DataFrame, extractions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tracker writes of approved extractions."""
    approved = extractions.where("status = 'approved'").select(F.col("id").alias("extraction_id"))
    return writes.join(approved, "extraction_id", "left_semi"), writes.join(approved, "extraction_id", "left_anti").withColumn("violations", F.array(F.lit("gate")))


def terminal_reopened(events: DataFrame) -> DataFrame:
    """Events that leave a terminal status."""
    before = F.lag("status_after").over(Window.partitionBy("extraction_id").orderBy("created_at", "seq"))
    return events.withColumn("previous_status", before).where(F.col("previous_status").isin(*TERMINAL_STATUS))


def immutable_changed(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Keys whose immutable column differs between two states."""
    return old.select(key, F.col(column).alias("old_value")).join(new.select(key, F.col(column).alias("new_value")), key).where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is missing; a null key is no reference."""
    return children.where(F.col(child_key).isNotNull()).join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def once_per_key(new: DataFrame, existing: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first new row of each key that is not there yet."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    return first.join(existing.select(key), key, "left_anti")


def strict(df: DataFrame, violations: DataFrame, prefix: str) -> DataFrame:
    """``df``, or the rule's error if anything violates it."""
    found = violations.limit(1).collect()
    if found:
        raise typed_error(f"{prefix}: {found[0].asDict()}")
    return df
