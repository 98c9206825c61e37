"""Connected components by alternating large-star and small-star steps, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewright.llm.common import checkpointed, swept


def _all_stars(edges: DataFrame) -> bool:
    """Whether every u has one edge and is no other's v: each component is then a star around its least node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out + into > 1 AND out > 0").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of orderable ids -> node, component (the least id reachable), for each node that has an edge to another.

    Self-loops, repeated edges and either direction are fine; edges with a null end are ignored; no edges give no rows.
    No neighbour list is ever collected: a star's centre may hold a third of all nodes. The least neighbours of the large-star
    step are checkpointed, so that their join with a centre's edges is one that Spark can split; in the small-star step every
    edge goes from a node to a lesser one, and a node has only as many as links to lesser ones were found for it.
    """
    e = checkpointed(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _all_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")))
        large = checkpointed(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        both = least = large = low = small = None  # spent
        swept(edges.sparkSession)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
