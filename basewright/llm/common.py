"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from contextlib import suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows and bytes of an Arrow batch, where the session leaves them to Spark: whole texts can be long, and each Python worker holds some batches.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless it has bounds of its own. The setting stays: a plan reads it when it runs."""
    for key, left, own in (("spark.sql.execution.arrow.maxRecordsPerBatch", {"10000"}, BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", {"67108864", "2147483647", str(2**63 - 1)}, BATCH_BYTES)):
        if spark.conf.get(key).removesuffix("b").removesuffix("B") in left:
            spark.conf.set(key, str(own))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where none is set, a temporary one in local mode; a cluster must name one."""
    small_batches(spark)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        own = sc.getConf().get("spark.checkpoint.dir", None)
        if not own and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def freed(kernel):
    """A kernel over batches that gives unused memory, Arrow's and the C library's, back to the system at its end: workers are used again by other stages."""

    @wraps(kernel)
    def run(batches):
        yield from kernel(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # a C library without malloc_trim keeps its free memory
            ctypes.CDLL(None).malloc_trim(0)
    return run


def swept(spark: SparkSession) -> None:
    """Collect garbage on the driver: only then does Spark drop shuffle files, broadcasts and checkpoints that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that holds it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of one byte a character take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_mod(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_enough(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows; counts no further than that."""
    return df.limit(most + 1).count() <= most


def string_bytes(df: DataFrame) -> int:
    """Bytes of all strings in df, with 32 more for each row and column."""
    size = sum((F.coalesce(F.octet_length(c) if kind == "string" else F.lit(0), F.lit(0)) + 32 for c, kind in df.dtypes), F.lit(0).cast("long"))
    return df.agg(F.sum(size)).first()[0] or 0


def numbered(df: DataFrame, order: list[Column], partitions: int) -> tuple[DataFrame, int]:
    """df with a column ordinal, from 1 on in the given order, and the number of rows.

    A range sort over all executors, written once; each partition is numbered on from those before it. Only the partitions' row
    counts go through the driver.
    """
    held = checkpointed(df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    before, total = [], 0
    for r in held.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row for each partition
        before.append((r.part, total))
        total += r["count"]
    starts = df.sparkSession.createDataFrame(before, "_part long, _before long")
    out = held.join(F.broadcast(starts), part == F.col("_part"))
    return out.withColumn("ordinal", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before"), total


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores added until none of the columns has one of them in any case."""
    taken = {c.lower() for c in columns}
    while any(n in taken for n in names):
        names = tuple(n + "_" for n in names)
    return list(names)
