"""Training of the score model from alignments."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewright.functions import expr as E
from basewright.operators.quality import FEATURES, scored_cycles
from basewright.operators.state import kept

MOST, C = 29_000_000, 0.2


def matched(signals: DataFrame, alignments: DataFrame) -> DataFrame:
    """A row for each cycle of aligned reads: scored_cycles' columns and label, 1 (match), 0 or null (beyond the tag); reverse reads are turned round."""
    keys = ["tile", "cluster"]
    flags = E.md_flags(F.col("md"))
    al = alignments.select(*keys, F.when(F.col("flag").bitwiseAND(16) != 0, F.reverse(flags)).otherwise(flags).alias("flags"))
    return scored_cycles(signals, keys).join(al, keys).withColumn("label", F.try_element_at("flags", F.col("cycle") + 1) - 1).drop("flags")


def labelled(signals: DataFrame, alignments: DataFrame, most: int = MOST) -> DataFrame:
    """The known bases of matched.

    At most about `most` of them: of N clusters of c cycles, with n the lesser of most and N * c, the first (N / 2 - n / c) / 2 are
    passed over and so many after them taken that there are no more than n known bases. A cluster is taken whole or not at all.
    """
    rows = matched(signals, alignments).where("label IS NOT NULL")
    size = signals.agg((F.max("cluster") + 1).alias("clusters"), F.max(F.size("signal")).alias("cycles")).first()
    if not size.clusters or not size.cycles:
        return rows
    n = min(most, size.clusters * size.cycles)
    start = max(0, math.ceil((size.clusters / 2 - n / size.cycles) / 2))
    rows, width = rows.where(F.col("cluster") >= start), max(1, size.clusters)
    if rows.count() <= n:
        return rows
    low, end = start, start + width
    while end - low > 1:  # the last cluster that still fits, by counts of 1,000 stretches at a time
        step, room = max(1, -(-(end - low) // 1000)), n - rows.where(F.col("cluster") < low).count()
        counts = {r.k: r["count"] for r in rows.where(F.col("cluster").between(low, end - 1)).groupBy(F.floor((F.col("cluster") - low) / step).alias("k")).count().collect()}
        k = 0
        while k * step < end - low and counts.get(k, 0) <= room:
            room -= counts.get(k, 0)
            k += 1
        low, end = low + k * step, min(end, low + (k + 1) * step)
        if step == 1:
            break
    return rows.where(F.col("cluster") < low)


def diagnostics(signals: DataFrame, alignments: DataFrame) -> DataFrame:
    """mean_s and sd_s of the score basis' variable over all cycles of aligned reads, and the number of mismatched bases."""
    s = F.least(5 * F.col("gap"), F.lit(19.5))
    return matched(signals, alignments).agg(F.avg(s).alias("mean_s"), F.stddev_pop(s).alias("sd_s"), F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("mismatches"))


def features(rows: DataFrame) -> DataFrame:
    """label, x: the sparse features as a map from index (from 0) to value."""
    s = F.least(5 * F.col("gap"), F.lit(19.5))
    b = E.hat_bin(s)
    beta = E.hat_beta(s, b)
    var, sig = F.least("var", F.lit(1.0)), F.greatest(F.least("sig", F.lit(3.0)), F.lit(0.0))
    pair = lambda i, v: F.struct((i if not isinstance(i, int) else F.lit(i)).cast("int").alias("i"), v.cast("double").alias("v"))
    fixed = [pair(b, beta), pair(b + 1, 1 - beta), pair(9, 1 / (0.02 + F.sqrt(var))), pair(10, F.log(0.02 + var)), pair(11, 1 / (0.01 + sig)), pair(12, 1 / (F.col("n") - F.col("cycle"))), pair(13, F.lit(3.0)), pair(69, F.lit(1.0))]
    early = F.when(F.col("cycle") <= 6, F.array(pair(F.col("cycle") + 14, F.lit(1.0)))).otherwise(F.array().cast("array<struct<i:int,v:double>>"))
    after = F.when(F.col("cycle") > 0, F.array(pair(F.coalesce("prev", F.lit(0)) * 12 + F.col("call") * 3 + F.col("rank") + 21, F.lit(1.0)))).otherwise(F.array().cast("array<struct<i:int,v:double>>"))
    return rows.select("label", F.concat(F.array(*fixed), early, after).alias("x"))


def pairing(signals: DataFrame, alignments: DataFrame) -> DataFrame:
    """clusters, aligned, paired, unpaired_clusters, unpaired_reads: how many find each other, and how many don't. One row."""
    keys = ["tile", "cluster"]
    a = signals.groupBy(*keys).agg(F.count("*").alias("a"))
    b = alignments.groupBy(*keys).agg(F.count("*").alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    pairs = a.join(b, (a.tile.eqNullSafe(b.tile)) & (a.cluster == b.cluster), "full")
    n = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).alias
    return pairs.agg(n("a", F.lit(True))("clusters"), n("b", F.lit(True))("aligned"), n("b", both)("paired"), n("a", ~both)("unpaired_clusters"), n("b", ~both)("unpaired_reads"))


def entries(x: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, value) of each entry of a column of sparse features."""
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    flat, sizes = x.flatten(), np.diff(np.asarray(x.offsets))
    return np.repeat(np.arange(len(x)), sizes), np.asarray(flat.field("i"), np.int64), np.asarray(flat.field("v"), float)


def partial_sums(w: np.ndarray, label: np.ndarray, row: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of the logistic loss of these rows, from their entries alone: the features are never dense."""
    n, k = len(label), len(w)
    sign = 2.0 * label - 1
    margin = sign * np.bincount(row, value * w[index], n)
    p = 1 / (1 + np.exp(np.minimum(margin, 700.0)))  # 1 - probability of the label
    gradient = np.bincount(index, value * (-sign * p)[row], k)
    hessian = np.zeros((k, k))
    starts = np.searchsorted(row, np.arange(n))
    sizes = np.diff(np.append(starts, len(row)))
    for shift in range(int(sizes.max(initial=0))):  # each entry with the entry `shift` places on in its row
        left = np.flatnonzero(np.arange(len(row)) - starts[row] + shift < sizes[row])
        right = left + shift
        part = np.bincount(index[left] * k + index[right], value[left] * value[right] * (p * (1 - p))[row[left]], k * k).reshape(k, k)
        hessian += part if shift == 0 else part + part.T
    return float(np.logaddexp(0, -margin).sum()), gradient, hessian


def sums_at(rows: DataFrame, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """partial_sums over all rows, added up in a tree: a task hands over one row of FEATURES**2 numbers."""
    k = len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + k + k * k)
        for b in batches:
            loss, g, h = partial_sums(w, np.asarray(b.column("label"), float), *entries(b.column("x")))
            total += np.concatenate([[loss], g, h.reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1).sum(axis=0) for b in batches if b.num_rows), np.zeros(1 + k + k * k))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    parts = rows.select("label", "x").mapInArrow(run, "s array<double>")
    total = np.sum([r.s for r in parts.repartition(16).mapInArrow(add, "s array<double>").collect()], axis=0)  # 16 rows
    return float(total[0]), total[1 : 1 + k], total[1 + k :].reshape(k, k)


def newton_step(w: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The least of the quadratic model with the L1 norm, by coordinate descent."""
    d, hd = np.zeros_like(w), np.zeros_like(w)
    for _ in range(1000):
        most = 0.0
        for i in range(len(w)):
            a, b, c = h[i, i], g[i] + hd[i], w[i] + d[i]
            z = -c if b + 1 >= a * c and b - 1 <= a * c else (-(b + 1) / a if b + 1 < a * c else -(b - 1) / a)
            if z:
                d[i] += z
                hd += z * h[:, i]
                most = max(most, abs(z))
        if most < 1e-10:
            break
    return d


def violation(w: np.ndarray, g: np.ndarray) -> float:
    """How far w is from optimal: the size of the least subgradient."""
    at_zero = np.maximum(np.abs(g) - 1, 0)
    return float(np.where(w > 0, np.abs(g + 1), np.where(w < 0, np.abs(g - 1), at_zero)).sum())


def train(rows: DataFrame, c: float = C, eps: float = 1e-5, rounds: int = 100) -> list[float]:
    """L1 logistic regression without intercept over rows (label, x): the weights.

    Newton's method with coordinate descent for the step: a round takes one pass over the kept rows, which gives loss, gradient and
    Hessian; the step's length is halved until it pays. Ends when the least subgradient is eps times the first one.
    """
    rows = kept(rows.select(F.col("label").cast("double").alias("label"), "x"))
    if rows.isEmpty():
        raise ValueError("no labelled bases")
    w = np.zeros(FEATURES)
    loss, g, h = sums_at(rows, w)
    first = None
    for _ in range(rounds):
        g, h = c * g, c * h + 1e-12 * np.eye(len(w))
        first = violation(w, g) if first is None else first
        if violation(w, g) <= eps * first:
            break
        d = newton_step(w, g, h)
        gain = g @ d + np.abs(w + d).sum() - np.abs(w).sum()
        step, now = 1.0, c * loss + np.abs(w).sum()
        while True:
            loss, g, h = sums_at(rows, w + step * d)
            if c * loss + np.abs(w + step * d).sum() - now <= 0.01 * step * gain or step < 1e-6:
                break
            step /= 2
        w = w + step * d
    return w.tolist()
