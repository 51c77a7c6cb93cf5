"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, as every contract of this subpackage has it (Java and Python regex).
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset a local folder serves local runs, as in tests; RuntimeError on a cluster, whose executors would not see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local_folder()


@lru_cache(1)
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="kinloom-")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut, and nothing is computed twice.

    The files are deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


_CLEARS: list[Callable[[], None]] = []


def kept(clear: Callable[[], None]) -> None:
    """Register what empties a memory that a Python worker keeps from task to task."""
    _CLEARS.append(clear)


def release() -> None:
    """Empty every such memory: a worker that goes on with another operator doesn't hold those of the one before."""
    for clear in _CLEARS:
        clear()


def trim() -> None:
    """Give memory that a worker has freed back to the system, as idle workers stay."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Rows and bytes of the batches that texts go to Python in: long texts make Spark's 10,000 rows hundreds of MB.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def small_batches(spark: SparkSession) -> None:
    """Lower the session's batch limits to BATCH where they are higher."""
    for key, most in BATCH.items():
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def map_arrow(df: DataFrame, rows: Callable[[pa.RecordBatch], dict], schema: str, *, keeps: bool = False) -> DataFrame:
    """mapInArrow over batches; rows gives columns by name, in the order of schema.  keeps: rows uses a worker's memory."""
    names = [x.split()[0] for x in schema.split(",")]
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            release()
        for batch in batches:
            if batch.num_rows:
                out = rows(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[n], type=target.field(n).type) for n in names], schema=target)
                del out
            del batch
        trim()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


KINDS = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()),
}


def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(n, KINDS[k]) for n, k in (x.split() for x in schema.split(","))])


#: Rows of a table of ids that are broadcast, a few bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def bounded(ids: DataFrame) -> DataFrame:
    """ids, a staged table of narrow rows, marked for broadcast if it has BROADCAST_ROWS rows or fewer."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with number, from 0 in the given order: rows go to tasks by ranges of the order, and tasks are counted first."""
    spread = stage(df.repartitionByRange(partitions(df), *order).withColumn("task", F.spark_partition_id()), "ranges")
    counts = spread.groupBy("task").agg(F.count(F.lit(1)).alias("rows"))
    counts = counts.select("task", F.coalesce(F.sum("rows").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("task").orderBy(*order)) - 1
    # One row for each task.
    return spread.withColumn("number", own).join(F.broadcast(counts), "task").withColumn("number", F.col("number") + F.col("before")).drop("task", "before")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def held_out(id_col: str, modulus: int, remainder: int):
    """crc32 of the id's text modulo modulus is remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
