"""Helpers shared by the corpus operators: scratch tables, ids and text normalisation."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_WRITTEN: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset and the master is
    ``local[...]`` is a temporary folder of this machine used.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="colloquy_")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{work_dir(spark)}/colloquy/{name}_{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor
    costs no more than the tasks that ran on it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session is already gone
            return


_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: the latest operator's, and no other's.

    Workers are used again for other stages, so what earlier ones kept would add up.
    """
    if name not in _KEPT:
        _KEPT.clear()
        give_back()
        _KEPT[name] = make()
    return _KEPT[name]


def give_back() -> None:
    """Return freed memory to the system; the allocators would hold it for a next time."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Rows that a Python worker takes up at a time; a batch of long texts is not unpacked as a whole.
SLICE = 500
#: Most rows and bytes that are sent to a Python worker at once.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small; a batch is held by the JVM and by the worker."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ARROW_ROWS:
        spark.conf.set(rows, str(ARROW_ROWS))
    spark.conf.set(size, str(ARROW_BYTES))


def shrink_executors(spark: SparkSession) -> None:
    """Ask the executors' JVMs to collect garbage and give back what they do not use, between two stages of a job.

    A heap that one stage has filled is otherwise kept beside the Python workers of the next one.  Results
    do not depend on it: an executor that no task reaches keeps its memory.
    """
    n = 2 * spark.sparkContext.defaultParallelism
    gc_call = F.java_method(F.lit("java.lang.System"), F.lit("gc"))
    # the id keeps the call from being folded to a constant
    spark.range(0, n, 1, n).where(gc_call.isNull() | (F.col("id") >= 0)).write.format("noop").mode("overwrite").save()

#: From slices of the columns read to (for each row made, the place of the row it is made of; None: row by row), new columns.
TextFunction = Callable[..., tuple[list[int] | None, list[list]]]


def map_texts(rows: DataFrame, make: Callable[[], TextFunction], added: str, keep: list[str] | None = None, read: tuple[str, ...] = ("text",)) -> DataFrame:
    """Rows with columns that Python makes of their texts, or other columns to ``read``.

    ``keep`` (all that is not read by default) stay as they are, bit for bit, as they never leave Arrow.
    ``make`` is called once for each partition.
    """
    keep = [c for c in rows.columns if c not in read] if keep is None else keep
    bound_batches(rows.sparkSession)
    new = T.StructType.fromDDL(added)
    schema = T.StructType([rows.schema[c] for c in keep] + [f for f in new])
    types = [f.type for f in to_arrow_schema(new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what another operator's task has left
        function = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                index, columns = function(*[part.column(c).to_pylist() for c in read])
                same = [part.column(c) if index is None else part.column(c).take(pa.array(index, pa.int64())) for c in keep]
                made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*same, *made], names=schema.names)
        function = None
        give_back()

    return rows.select(*dict.fromkeys([*keep, *read])).mapInArrow(run, schema)


def prefixed(docs: DataFrame) -> DataFrame:
    """``docs`` with names that no operator's own columns have."""
    return docs.select(*[F.col(f"`{c}`").alias(f"_doc_{c}") for c in docs.columns])


def original(docs: DataFrame, **new: Column) -> list[Column]:
    """The columns of ``docs``, of a prefixed frame, with some of them replaced."""
    return [new.get(c, F.col(f"`_doc_{c}`")).alias(c) for c in docs.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(doc_id: Column) -> Column:
    """Unsigned CRC-32 of the id written as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


#: Bits of the filter of keys: 2 MB.  Its size is fixed; with more keys it lets more rows through.
FILTER_BITS = 1 << 24


def may_match(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` and _maybe, false where their key ``on`` is surely none of ``keys``.

    A bitmap of hashed keys, FILTER_BITS / 8 bytes, is broadcast, so that long columns of other rows need
    not be moved for a join with ``keys``.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(FILTER_BITS)) + 1
    bitmaps = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))
    # as whole numbers of 64 bits, eight bytes each from the highest: a row's test is a look into an array
    long_at = lambda i: F.conv(F.hex(F.substring("_bits", i * 8 + 1, F.lit(8))), 16, -10).cast("long")
    bitmaps = bitmaps.select("_bucket", F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("_bits") - 1) / 8).cast("int")), long_at).alias("_bits"))
    bit = F.bitmap_bit_position(place).cast("int")
    known = F.getbit(F.get("_bits", F.shiftright(bit, 6)), bit.bitwiseAND(F.lit(63)).bitwiseXOR(F.lit(56))) == 1
    joined = rows.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bitmaps), "_bucket", "left")
    return joined.withColumn("_maybe", F.coalesce(known, F.lit(False))).drop("_bucket", "_bits")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
