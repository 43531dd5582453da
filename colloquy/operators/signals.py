"""Chat signals: batches, checks of model answers, and what becomes of each class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.relational import ranked_in_buckets
from colloquy.schemas import QUEUED_CLASSES

BATCH = 20


def signal_batches(messages: DataFrame, size: int = BATCH) -> DataFrame:
    """Messages with their batch within the channel, in time order.

    A busy channel is ranked day by day: ``ts`` is an ISO time, of which the first ten characters are the day.
    """
    day = F.coalesce(F.left(F.col("ts").cast("string"), F.lit(10)), F.lit(""))
    rows = ranked_in_buckets(messages, ["channel"], day, F.col("ts").asc_nulls_first(), F.col("id"), name="_n")
    return rows.withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("int")).drop("_n")


def render_batches(batched: DataFrame) -> DataFrame:
    line = F.concat(F.lit("["), F.col("id"), F.lit("] "), F.col("author"), F.lit(" at "), F.col("ts"), F.lit(" in #"), F.col("channel"), F.lit("\n    "), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("ts", "id", line.alias("line"))))
    return batched.groupBy("channel", "batch").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("prompt"), F.count("*").alias("n"))


def answer_problems(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """message_id, problem: ids that a model made up, and ids that it left out."""
    unknown = answers.select("message_id").distinct().join(messages.select(F.col("id").alias("message_id")), "message_id", "left_anti").withColumn("problem", F.lit("unknown"))
    missing = messages.select(F.col("id").alias("message_id")).join(answers.select("message_id"), "message_id", "left_anti").withColumn("problem", F.lit("missing"))
    return unknown.unionByName(missing)


def classify(messages: DataFrame, labels: DataFrame) -> DataFrame:
    """Messages with classification and confidence; without a label, both are null."""
    return messages.join(labels.select(F.col("message_id").alias("id"), "classification", "confidence"), "id", "left")


def route() -> Column:
    """queued for review, stored, or discarded."""
    return F.when(F.col("classification").isin(*QUEUED_CLASSES), "queued").when(F.col("classification") == "noise", "discarded").otherwise("stored")


def without_noise(classified: DataFrame) -> DataFrame:
    noise = classified.where("classification = 'noise'").select("id")
    return classified.join(noise, "id", "left_anti")


def run_counts(classified: DataFrame) -> DataFrame:
    return classified.agg(
        F.count("*").alias("messages_seen"), F.count("classification").alias("classified"), F.count_if(route() == "queued").alias("queued"), F.count_if(F.col("classification") == "noise").alias("noise_discarded")
    )
