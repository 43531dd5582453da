"""Base tables, and the tables of the data model that stand for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.segments import normalise_segments


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_by_key(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; the filter reaches the scan."""
    return df.where(F.col(key) == F.lit(value))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as offset-addressed segments."""
    raw = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("segment_index"), F.col("role").alias("speaker"), "text")
    return normalise_segments(raw)


def json_text(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
