"""Cycle blocks, cluster chunks and stripes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, BUFFER, STRIPE, HALO = 14, 6, 250, 15


def block_plan(cycles: int, size: int = BLOCK, buffer: int = BUFFER) -> list[tuple[int, int, int, int, int]]:
    """(block, start, len, buf_start, buf_len) of each block: lengths as even as can be, the longer ones first."""
    n = max(1, -(-cycles // size))
    out, start = [], 0
    for b in range(n):
        length = cycles // n + (b < cycles % n)
        lo, hi = max(0, start - buffer), min(cycles, start + length + buffer)
        out.append((b, start, length, lo, hi - lo))
        start += length
    return out


def cycle_blocks(runs: DataFrame, size: int = BLOCK, buffer: int = BUFFER) -> DataFrame:
    """runs (cycles) -> cycles, block, start, len, buf_start, buf_len: block_plan of each row."""
    n, cycles, k = F.greatest(F.ceil(F.col("cycles") / size), F.lit(1)).cast("int"), F.col("cycles"), F.col("block")
    rows = runs.select("cycles", n.alias("n")).select("cycles", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"))
    each, more = F.floor(cycles / F.col("n")).cast("int"), cycles % F.col("n")
    start, length = each * k + F.least(k, more), each + (k < more).cast("int")
    rows = rows.select("cycles", "block", start.alias("start"), length.alias("len"))
    low = F.greatest(F.col("start") - buffer, F.lit(0))
    return rows.select("cycles", "block", "start", "len", low.alias("buf_start"), (F.least(F.col("start") + F.col("len") + buffer, cycles) - low).alias("buf_len"))


def chunk_size(blocks, size: int = BLOCK):
    return 625 * (2 * BUFFER + size + 2) * blocks


def chunk_of(cluster, total, chunks):
    """The chunk of a cluster number; boundary k lies at floor(total / chunks * k + 0.5). All three may be columns."""
    cluster, total, chunks = (x if isinstance(x, Column) else F.lit(x) for x in (cluster, total, chunks))
    share = total / chunks.cast("double")
    near = F.least(F.floor(cluster / share), chunks - 1)  # a boundary off by one at most
    beyond = (near < chunks - 1) & (cluster >= F.floor(share * (near + 1) + 0.5))
    short = (near > 0) & (cluster < F.floor(share * near + 0.5))
    return (near + beyond.cast("int") - short.cast("int")).cast("int")


def stripes(snapped: DataFrame, extent, size: int = STRIPE, halo: int = HALO) -> DataFrame:
    """Rows of snapped (gx) for each stripe whose core or halo holds them. The last core reaches to the end."""
    count = F.greatest(F.ceil(extent / size), F.lit(1)).cast("int")
    # stripe i has its core from size * i - halo up to size * (i + 1) - halo, and `halo` more on either side
    core = F.least(F.floor((F.col("gx") + halo) / size), count - 1).cast("int")
    low = F.greatest(F.least(F.floor(F.col("gx") / size), count - 1), F.lit(0))
    high = F.least(F.floor((F.col("gx") + 2 * halo) / size), count - 1)
    return snapped.withColumn("stripe", F.explode(F.sequence(F.least(low, high).cast("int"), F.greatest(low, high).cast("int")))).withColumn("in_core", F.col("stripe") == core)
