"""Groups of classes that lie in several components, compared in pairs of bounded blocks inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewright.llm.common import checkpointed, freed, shuffle_partitions

BLOCK, BLOCK_SHINGLES, LARGE = 512, 2_000_000, 64


def column(rows: list[tuple], at: int) -> np.ndarray:
    return np.array([r[at] for r in rows], np.int64)


def pairs_of_blocks(decide):
    """Rows (key, i, j, side, node, c, data), a block pair (key, i, j) together -> what decide(left, right) gives, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []

        def emit() -> pa.RecordBatch:
            a, b = (np.concatenate([np.asarray(x[i], np.int64) for x in out]) if out else np.empty(0, np.int64) for i in (0, 1))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        def close() -> None:
            if len({r[5] for r in rows}) > 1:
                left = [r for r in rows if r[3] == r[1]]
                right = [r for r in rows if r[3] == r[2]]
                if left and right:
                    out.append(decide(left, right))

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:3] != now:
                    close()
                    now, rows = r[:3], []
                rows.append(r)
            yield emit()
        close()
        yield emit()
    return run


def open_groups(members: DataFrame) -> DataFrame:
    """members (bucket, node, c) of all buckets -> (key, main, node, c), each once: the members of the buckets that lie in several components.

    main is the component with most of a bucket's members; buckets of over LARGE members with the same main are one group.
    """
    parts = members.groupBy("bucket", "c").agg(F.count("*").alias("n"))
    whole = parts.groupBy("bucket").agg(F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("n")).where("n > m.n")
    key = F.when(F.col("n") > LARGE, F.xxhash64(F.lit("component"), "m.c")).otherwise(F.col("bucket"))
    whole = checkpointed(whole.select("bucket", key.alias("key"), F.col("m.c").alias("main")))
    return members.join(whole, "bucket").select("key", "main", "node", "c").distinct()


def by_blocks(rows: DataFrame, data: DataFrame, decide, weight=None) -> DataFrame:
    """rows (key, main, node, c) and data (node, data) -> distinct (a, b) that decide gives for the pairs of a group's blocks.

    The members of the component `main` fill blocks of their own, which meet only the others' blocks, never each other.
    """
    is_main, place = F.col("c") == F.col("main"), F.xxhash64("node")
    w = F.lit(0) if weight is None else weight
    blocks = lambda of: F.greatest(F.ceil(F.count(F.when(of, 1)) / BLOCK), F.ceil(F.sum(F.when(of, w).otherwise(0)) / BLOCK_SHINGLES), F.lit(1)).cast("int")
    sizes = checkpointed(rows.groupBy("key").agg(blocks(~is_main).alias("rest"), blocks(is_main).alias("more")))
    side = F.when(is_main, F.col("rest") + F.pmod(place, F.col("more"))).otherwise(F.pmod(place, F.col("rest"))).cast("int")
    others = F.sequence(F.lit(0), F.when(is_main, F.col("rest")).otherwise(F.col("rest") + F.col("more")) - 1)
    placed = rows.join(sizes, "key").withColumn("side", side).join(data, "node").withColumn("other", F.explode(others))
    placed = placed.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "c", "data")
    placed = placed.repartition(shuffle_partitions(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "node")
    return placed.mapInArrow(freed(pairs_of_blocks(decide)), "a long, b long").distinct()


def joined_components(components: DataFrame, more: DataFrame) -> DataFrame:
    """components (node, component) after further links between components, (u, v)."""
    from basewright.llm.components import connected_components

    joined = checkpointed(connected_components(more.toDF("u", "v"))).withColumnRenamed("component", "least")
    renamed = components.join(joined.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    alone = joined.join(components.select("node"), "node", "left_anti").select("node", F.col("least").alias("component"))
    return renamed.unionByName(alone)
