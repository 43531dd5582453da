"""Relational operators that the engine's reads are made of."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_of(**equal) -> Column:
    """Conjunction of the equalities whose value is not None."""
    conditions = [F.col(c) == v for c, v in equal.items() if v is not None]
    return functools.reduce(operator.and_, conditions, F.lit(True))


def tri_state(column: str, present: bool | None) -> Column:
    """Not null, null, or either."""
    if present is None:
        return F.lit(True)
    return F.col(column).isNotNull() if present else F.col(column).isNull()


def in_scope(column: str, scope) -> Column:
    """IN a list; an empty or missing list does not filter."""
    return F.col(column).isin(list(scope)) if scope else F.lit(True)


def differs(column: Column, value) -> Column:
    """Null-safe inequality."""
    return ~column.eqNullSafe(F.lit(value))


def same_text(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def count_by(df: DataFrame, column: str, missing: str = "unclassified") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias(column)).agg(F.count("*").alias("n"))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows in a total order; every task keeps k rows at most."""
    return df.orderBy(*order).limit(k)


def ranked(df: DataFrame, partition: list[str], *order: Column, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def ranked_in_buckets(df: DataFrame, keys: list[str], bucket: Column, *order: Column, name: str = "rank") -> DataFrame:
    """``ranked`` for keys that may hold a large part of all rows.

    ``bucket`` is not null and never falls in the order within a key: rows are ranked within their bucket, and moved by how
    many rows the buckets before have.
    """
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select(*keys, "_bucket", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return rows.withColumn("_within", within).join(shifts, [*keys, "_bucket"]).withColumn(name, (F.col("_before") + F.col("_within")).cast("int")).select(*df.columns, name)


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return ranked(df, keys, *order, name="_n").where("_n = 1").drop("_n")


def next_version(df: DataFrame, key: str, version: str) -> DataFrame:
    return df.groupBy(key).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def next_reference(refs: DataFrame, column: str, prefix: str = "MOCK") -> DataFrame:
    """The largest number in PREFIX-number, plus one."""
    number = F.regexp_extract(column, rf"^{prefix}-(\d+)$", 1).try_cast("long")
    return refs.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_number"))


def changed_only(new: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows whose key and content hash are not stored as ingested."""
    return new.join(stored.where("status = 'ingested'").select(key, digest), [key, digest], "left_anti")


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``stored`` with the rows of ``new`` in place of, or beside, those with the same key."""
    a, b = stored.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full_outer")
    fresh = F.col(f"b.{key}").isNotNull()
    return joined.select(*[F.when(fresh, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in stored.columns])


def coalesce_update(stored: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """``stored`` with every edited value that is not null."""
    edited = [c for c in edits.columns if c != key]
    renamed = edits.withColumnsRenamed({c: f"_new_{c}" for c in edited})
    return stored.join(renamed, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in edited else F.col(c) for c in stored.columns])


def without_children(parent_keys: DataFrame, key: str, *children: DataFrame) -> list[DataFrame]:
    """Child tables without the rows of deleted parents."""
    return [c.join(parent_keys.select(key), key, "left_anti") for c in children]


def content_hash(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256)
