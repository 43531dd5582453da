"""Sinks: keyed overwrites, append-only logs, versioned records, documents."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.relational import next_version, upsert


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Overwrite the partitions of the keys that ``df`` holds, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def replace_sources(df: DataFrame, path: str, replaced: DataFrame, key: str = "source_id") -> None:
    """Replace all rows of the keys in ``replaced`` by ``df``; a key without new rows keeps none."""
    stored = df.sparkSession.read.parquet(path)
    swap_in(stored.join(replaced.select(key).distinct(), key, "left_anti").select(*stored.columns).unionByName(df.select(*stored.columns)), path)


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("append").format(fmt).save(path)


def swap_in(df: DataFrame, path: str) -> None:
    """Replace a table by ``df``, which may read from it: written aside first, then renamed.

    One table is replaced as a whole.  Several cannot be replaced at once on plain files.
    """
    spark = df.sparkSession
    aside, old = f"{path}_new_{uuid.uuid4().hex}", f"{path}_old_{uuid.uuid4().hex}"
    df.write.parquet(aside)
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    if not fs.rename(at(aside), at(path)):
        fs.rename(at(old), at(path))
        raise OSError(f"{path} could not be replaced")
    fs.delete(at(old), True)


def upsert_into(new: DataFrame, path: str, key: str) -> None:
    spark = new.sparkSession
    swap_in(upsert(spark.read.parquet(path), new, key), path)


def write_versioned(records: DataFrame, path: str, key: str = "source_id", version: str = "record_version") -> DataFrame:
    """Records as JSON under the next version of their key; the rows with their versions."""
    spark = records.sparkSession
    try:
        stored = spark.read.json(path).select(key, version)
    except Exception as e:  # noqa: BLE001 - nothing is stored yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        stored = spark.createDataFrame([], f"{key} string, {version} int")
    versions = next_version(stored, key, version).withColumnRenamed("next_version", version)
    out = records.join(versions, key, "left").withColumn(version, F.coalesce(version, F.lit(1)).cast("int"))
    out.select(key, version, F.to_json(F.struct(*records.columns)).alias("record")).write.mode("append").partitionBy(key, version).json(path)
    return out


def safe_key(key: str) -> str:
    """A document key that stays inside its root."""
    if not key or key.startswith("/") or "\\" in key or ".." in key.split("/") or not re.fullmatch(r"[\w\-./]+", key):
        raise ValueError(f"key {key!r} leaves the store")
    return key


def write_document(spark: SparkSession, root: str, key: str, content: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/{safe_key(key)}")
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(content.encode("utf-8")))
    finally:
        stream.close()


def document_exists(spark: SparkSession, root: str, key: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{safe_key(key)}")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def append_log(df: DataFrame, path: str) -> str | None:
    """Append JSON lines; a failure is told and not raised, as a log must not stop the work it tells of."""
    try:
        df.write.mode("append").json(path)
    except Exception as e:  # noqa: BLE001
        return str(e)
    return None
