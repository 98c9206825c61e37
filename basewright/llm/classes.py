"""Rows, classes of rows with equal shingle sets, and what components of classes mean for documents.

A row is known by doc_id and version, a hash of its text. Rows with equal sets are one class, whose least row stands for it and
which has a number of its own; links and components are between classes, so neither exact copies nor ids that stand on several
texts blur them. A document is a doc_id: the components of all its texts are one for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basewright.llm.common import checkpointed, freed, shuffle_partitions, small_enough
from basewright.llm.components import connected_components
from basewright.llm.shingles import shingle_set

#: Rows up to which classes, pivots' sizes and the like (40 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Documents that are compared with one copy of a pivot's text.
SALT = 64


def near(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if small_enough(df, most) else df


def version_of(text: Column) -> Column:
    return F.xxhash64(text.cast("binary"))


def rows_of(documents: DataFrame) -> DataFrame:
    """doc_id, version, text (as bytes)."""
    text = F.col("text").cast("binary")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), version_of(text).alias("version"), text.alias("text"))


def classes_of(features: DataFrame) -> DataFrame:
    """features (doc_id, version, n_shingles, k1, k2, ...) -> node, k1, k2, doc_id, version: a row for each distinct set that isn't
    empty and has a doc_id; doc_id and version are those of its least row."""
    real = features.where("n_shingles > 0 AND doc_id IS NOT NULL")
    least = checkpointed(real.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "version")).alias("r")))
    # numbers by place in the checkpoint, which a task that runs again finds as it was
    return checkpointed(least.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "r.doc_id", "r.version"))


def of_classes(features: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """node and columns of features, from the row that stands for each class (once for each row that repeats it)."""
    return features.select("k1", "k2", "doc_id", "version", *columns).join(near(nodes), ["k1", "k2", "doc_id", "version"]).select("node", *columns)


def documents_of(features: DataFrame, nodes: DataFrame, components: DataFrame) -> DataFrame:
    """doc_id, version, n_shingles, component_id, first: a row for each of features.

    components (node, component) has the classes with a link. component_id is the least doc_id of all documents that links reach,
    a document's texts taken together; first tells the row with the least (doc_id, version) of its texts' component.
    """
    of_node = nodes.select("k1", "k2", "node").join(near(components), "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("c"))
    rows = features.select("doc_id", "version", "n_shingles", "k1", "k2").join(near(checkpointed(of_node)), ["k1", "k2"], "left")
    rows = checkpointed(rows.withColumn("c", F.when(F.col("doc_id").isNotNull(), F.col("c"))).drop("k1", "k2"))
    # a component of one row is its own first; the others' firsts are joined
    row = F.struct("doc_id", "version")
    firsts = rows.where("c IS NOT NULL").groupBy("c").agg(F.min(row).alias("f"), F.max(row).alias("l")).where("f <> l").select("c", "f")
    rows = checkpointed(rows.join(near(checkpointed(firsts)), "c", "left"))
    several = rows.where("c IS NOT NULL").groupBy("doc_id").agg(F.min("c").alias("v"), F.max("c").alias("l")).where("v <> l").select("doc_id", "v")
    bridges = checkpointed(rows.join(near(checkpointed(several)), "doc_id").where("c <> v").select(F.col("c").alias("u"), "v").distinct())
    first = F.coalesce((F.col("doc_id") == F.col("f.doc_id")) & (F.col("version") == F.col("f.version")), F.lit(True))
    component = F.coalesce("f.doc_id", "doc_id")
    if not bridges.isEmpty():
        joined = checkpointed(connected_components(bridges).select(F.col("node").alias("c"), F.col("component").alias("all")))
        rows = rows.join(near(joined), "c", "left")
        least = rows.where("`all` IS NOT NULL").groupBy("all").agg(F.min("doc_id").alias("least"))
        rows = rows.join(near(checkpointed(least)), "all", "left")
        component = F.coalesce("least", component)
    return rows.select("doc_id", "version", "n_shingles", component.alias("component_id"), first.alias("first"))


def _confirmed(k: int, percent: int):
    """Rows (p, salt, role, node, text), a pivot before its classes -> links (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = None, None
        for batch in batches:
            u, v = [], []
            for p, role, d, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if role == 0:
                    if p != pivot:
                        pivot, own = p, shingle_set(text.as_py(), k)
                elif p == pivot:
                    s = shingle_set(text.as_py(), k)
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        u.append(d)
                        v.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
    return run


def confirmed_links(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs (p, d) of classes, each once -> those that the full sets of whole texts confirm, as (u, v). A pivot's documents are dealt out with SALT to a copy of it."""
    sizes = checkpointed(pairs.groupBy("p").agg(F.greatest(F.ceil(F.count("*") / SALT), F.lit(1)).cast("int").alias("salts")))
    docs = pairs.join(near(sizes), "p").select("p", F.pmod(F.xxhash64("d"), "salts").cast("int").alias("salt"), F.lit(1).alias("role"), F.col("d").alias("node"))
    own = sizes.select("p", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("p").alias("node"))
    wanted = docs.unionByName(own).join(near(nodes.select("node", "doc_id", "version")), "node")
    texts = rows.join(near(checkpointed(wanted)), ["doc_id", "version"]).select("p", "salt", "role", "node", "text")
    texts = texts.repartition(shuffle_partitions(rows.sparkSession), "p", "salt").sortWithinPartitions("p", "salt", "role", "node")
    return checkpointed(texts.mapInArrow(freed(_confirmed(k, percent)), "u long, v long").distinct())


def _sets(k: int):
    """(node, text) -> (node, data): the set of shingles as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                piece = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([shingle_set(t.as_py(), k).tobytes() for t in piece.column(1)], pa.binary())], names=["node", "data"])
    return run


def sets_of(rows: DataFrame, nodes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, data (the sorted set as bytes) of each class in wanted (node), once."""
    asked = checkpointed(nodes.join(near(wanted), "node", "left_semi").select("node", "doc_id", "version"))
    return rows.join(near(asked), ["doc_id", "version"]).select("node", "text").dropDuplicates(["node"]).mapInArrow(freed(_sets(k)), "node long, data binary")
