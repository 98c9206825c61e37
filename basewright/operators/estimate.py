"""Color and phasing estimation: numpy kernels for one chunk, and the chain of chunks as ordered, stateful grouped processing.

A chunk is bounded (chunk_size clusters). Chunks start from the parameters of the one before, as the method asks for, so the rows of
a (tile, end) reach one task in order and stream through it: it holds one chunk and the parameters. Tiles and ends run side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basewright.operators.blocks import BLOCK, block_plan, chunk_of, chunk_size
from basewright.operators.tensor import FAULTS, ROWS, ROWS_DDL, batches_of, failure, tensor_of

#: The four bases' signals in channel space that k-means starts from.
CENTROIDS = np.array([[3300.0, 3300.0, 0.0, 0.0], [600.0, 2800.0, 0.0, 0.0], [0.0, 0.0, 2800.0, 2600.0], [0.0, 0.0, 0.0, 3300.0]])


@dataclass
class Params:
    color: list[np.ndarray]  # per block 4 x 5: mixing and background
    phase: list[np.ndarray]  # per block len x (buffer + 2): mixing, previous, constant


def calls_of(z: np.ndarray) -> np.ndarray:
    """Argmax over the last axis from 0 on."""
    return np.where(z.max(axis=-1) > 0, z.argmax(axis=-1), 0)


def bright(first: np.ndarray) -> np.ndarray:
    """Which clusters' norms exceed half the mean norm."""
    norm = np.linalg.norm(first, axis=1)
    return norm > norm.mean() / 2


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, cosines) of each row of x to the rows of c."""
    cos = x @ c.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(c, axis=1) + 1e-12)
    return calls_of(cos), cos


def centroids_of(x: np.ndarray, k: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Class means; an empty class keeps its centroid of c."""
    return np.array([x[k == j].mean(axis=0) if (k == j).any() else c[j] for j in range(4)])


def trimmed(members: np.ndarray, c: np.ndarray, rounds: int = 2, step: float = 1.25, limit: float = 0.2) -> np.ndarray:
    """A centroid moved over-relaxed toward the mean of its members of near direction, under a limit that tightens."""
    for _ in range(rounds):
        near = members[1 - nearest(members, c[None])[1][:, 0] < limit]
        if len(near) > 2:
            c = c + step * (near.mean(axis=0) - c)
        limit = limit**2 * 3
    return c


def with_background(c: np.ndarray) -> np.ndarray:
    """Centroids -> 4 x 5: mixing columns and background. The first two channels' background is what the last two bases have there, and the other way round."""
    back = np.array([*[(c[2, i] + c[3, i]) / 2 for i in (0, 1)], *[(c[0, i] + c[1, i]) / 2 for i in (2, 3)]])
    return np.hstack([c.T - back[:, None], back[:, None]])


def color_seed(first: np.ndarray, rounds: int = 5) -> np.ndarray:
    """First cycle (n x 4) -> 4 x 5: k-means on direction, trimmed and over-relaxed, and the background. Trimming keeps the classes of the last assignment."""
    x, c = first[bright(first)], CENTROIDS.copy()
    if not len(x):
        return np.hstack([c.T, np.zeros((4, 1))])
    for _ in range(rounds):
        k, _ = nearest(x, c)
        before, c = c, centroids_of(x, k, c)
        if np.linalg.norm(c - before) < np.linalg.norm(before) / 1e4:
            break
    return with_background(np.array([trimmed(x[k == j], c[j]) for j in range(4)]))


def infer_phase(plan: list[tuple], phase: list[np.ndarray], b: int) -> np.ndarray:
    """Block b's phasing before any fit, from those of block 0 and b - 1: each row carries the last on, a little of it behind or ahead."""
    _, _, length, lo, size = plan[b]
    p = np.zeros((length, size + 2))
    pha = pre = 0.002
    stop, const, dim, up = 0.001, 0.0, 0.997, None
    if b:
        first, last = phase[0], phase[b - 1]
        _, _, len0, _, size0 = plan[0]
        i = len0 - 1
        pre = first[i, min(i + 1, size0 - 1)] / first[i, i] / len0
        pha = first[i, i - 1] / first[i, i] / len0 if i else 0.0
        stop, const = last[:, -2].mean(), last[:, -1].mean()
        lenb = plan[b - 1][2]
        dim = (last[-1, :-2].sum() / last[0, :-2].sum() + lenb - 1) / lenb
        up = np.zeros(size)
        keep = last[-1, lo - plan[b - 1][3] : -2][:size]
        up[: len(keep)] = keep
    for t in range(length):
        if up is None:
            p[0, 0] = 1
        else:
            p[t, :size] = dim * (pha * up + (1 - pha - pre) * np.concatenate([[0], up[:-1]]) + pre * np.concatenate([[0, 0], up[:-2]]))
            p[t, -2], p[t, -1] = stop, const
        up = p[t, :size]
    return p


def phase_seed(plan: list[tuple]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for b in range(len(plan)):
        out.append(infer_phase(plan, out, b))
    return out


@dataclass(frozen=True)
class Round:
    """One round of estimation: how strongly parameters are held, how sharply residuals weigh, and the extra hold on the constant terms."""

    stein: float
    wl: float
    extra: int
    last: bool


def schedule(chunk: int, iterations: int, fast: bool, serial: bool = False) -> list[Round]:
    """The rounds of a chunk; none where a fast run reuses its parameters. serial: the block-by-block variant, which adds no rounds."""
    if serial:
        rounds = iterations if chunk == 0 else 1
    else:
        rounds = iterations + 1 if chunk == 0 else 1 + (chunk < 2 or chunk < 4 and not fast)
        if fast and rounds == 1 and chunk % 4:
            return []
    out, stein, wl = [], *((0.05, 30.0) if chunk == 0 else (0.01, 40.0))
    for i in range(rounds):
        out.append(Round(stein, wl, rounds - i + 1 - 2 * (i > 0) if rounds > 1 else 0, i == rounds - 1))
        stein, wl = (stein - 0.0162 if stein > 0.02 else stein / 1.5), 10.0 * (i + (3 if serial else 4))
    return out


#: Sums over clusters that a fit needs: the regressors' products, those with the outputs, and the squared weights.
Sums = tuple[np.ndarray, np.ndarray, float]


def pulled(sums: Sums, prior: np.ndarray, hold: float, extra: float) -> tuple[np.ndarray, np.ndarray]:
    """The normal equations of least squares toward prior (outputs x regressors), held by `hold` for each squared weight, with an extra hold on the last regressor."""
    g, r, squares = sums
    tw = hold * squares
    g = g + tw * np.eye(len(g))
    g[-1, -1] += tw * extra
    return g, r + tw * prior.T


class Chunk:
    """One chunk's state; signal is n x cycles x 4."""

    def __init__(self, signal: np.ndarray, params: Params | None = None, block: int = BLOCK):
        self.x = np.asarray(signal, float)
        n, cycles, _ = self.x.shape
        self.plan, self.fresh = block_plan(cycles, block), params is None
        color = color_seed(self.x[:, 0]) if params is None else None
        self.color = [color.copy() for _ in self.plan] if params is None else [c.copy() for c in params.color]
        self.phase = phase_seed(self.plan) if params is None else [p.copy() for p in params.phase]
        self.lam, self.w = np.ones((len(self.plan), n)), np.ones((len(self.plan), n))
        total = np.concatenate([np.zeros((n, 1, 4)), np.cumsum(self.x, axis=1)], axis=1)
        self.previous = [total[:, lo] / max(5, lo) for _, _, _, lo, _ in self.plan]
        self.scale = np.linalg.norm(np.diag(self.color[0][:, :4])) / 2
        self.calls = np.zeros((n, cycles), int)
        self.out = np.zeros_like(self.x)
        self.index = np.arange(n)  # places in the whole chunk, where this is a part of it

    def source(self, b: int) -> np.ndarray:
        """n x buffer x 4: one-hot calls times brightness."""
        _, _, _, lo, size = self.plan[b]
        return np.eye(4)[self.calls[:, lo : lo + size]] * self.lam[b][:, None, None]

    def constants(self, b: int, background: bool) -> np.ndarray:
        """n x len x 4 of what the block's own cycles hold besides the source."""
        p = self.phase[b]
        out = self.previous[b][:, None, :] * p[None, :, -2:-1] + p[None, :, -1:] * self.scale
        return out + self.color[b][:, 4] if background else out

    def own(self, b: int) -> np.ndarray:
        _, start, length, _, _ = self.plan[b]
        return self.x[:, start : start + length]

    def phase_sums(self, b: int) -> Sums:
        """One channel a cluster, in turn: what the buffer's cycles, the light before and a constant add to the block's cycles."""
        n = len(self.x)
        c, w = self.index % 4, self.w[b]
        h = self.source(b) @ self.color[b][:, :4].T
        rows = np.arange(n)
        x = np.concatenate([h[rows, :, c], self.previous[b][rows, c][:, None], np.full((n, 1), self.scale)], axis=1) * w[:, None]
        y = (self.own(b)[rows, :, c] - self.color[b][c, 4][:, None]) * w[:, None]
        return x.T @ x, x.T @ y, float((w**2).sum())

    def phase_normal(self, b: int, stein: float, extra: float, sums: Sums | None = None) -> tuple[np.ndarray, np.ndarray]:
        return pulled(sums or self.phase_sums(b), self.phase[b], stein * self.scale**2, extra)

    def fit_phase(self, b: int, stein: float, extra: float, sums: Sums | None = None) -> np.ndarray:
        return np.linalg.solve(*self.phase_normal(b, stein, extra, sums)).T

    def color_sums(self, b: int) -> Sums:
        """One cycle a cluster, in turn: what the four bases and a constant add to the channels."""
        n, w = len(self.x), self.w[b]
        t, rows = self.index % self.plan[b][2], np.arange(n)
        h = np.einsum("ns,nsk->nk", self.phase[b][t, :-2], self.source(b))
        x = np.concatenate([h, np.ones((n, 1))], axis=1) * w[:, None]
        y = (self.own(b) - self.constants(b, False))[rows, t] * w[:, None]
        return x.T @ x, x.T @ y, float((w**2).sum())

    def color_normal(self, b: int, stein: float, extra: float, sums: Sums | None = None) -> tuple[np.ndarray, np.ndarray]:
        return pulled(sums or self.color_sums(b), self.color[b], stein, extra)

    def fit_color(self, b: int, stein: float, extra: float, sums: Sums | None = None) -> np.ndarray:
        c = np.linalg.solve(*self.color_normal(b, stein, extra, sums)).T
        c[:, :4] *= 2 * self.scale / np.linalg.norm(np.diag(c[:, :4]))
        return c

    def reach(self, b: int, side: int) -> tuple[int, int]:
        """First cycle and end of what a solve of block b takes in: side -1 the block alone, 0 the buffer before it too, 1 that after it too."""
        _, start, length, lo, size = self.plan[b]
        return (start if side < 0 else lo), (lo + size if side > 0 else start + length)

    def deconvolve(self, b: int, side: int) -> np.ndarray:
        """n x len x 4: constants removed, colors and phasing inverted over the cycles within reach; neighbours' rows come from their blocks."""
        _, start, length, _, _ = self.plan[b]
        first, last = self.reach(b, side)
        z, m = [], np.zeros((last - first, last - first))
        for k, (_, s, n, klo, ksize) in enumerate(self.plan):
            lo, hi = max(s, first), min(s + n, last)
            if lo < hi:
                y = (self.own(k) - self.constants(k, True))[:, lo - s : hi - s]
                z.append(y @ np.linalg.inv(self.color[k][:, :4]).T)
                a, e = max(first, klo), min(last, klo + ksize)
                m[lo - first : hi - first, a - first : e - first] = self.phase[k][lo - s : hi - s, a - klo : e - klo]
        own = np.linalg.inv(m)[start - first : start - first + length]
        return np.einsum("ts,nsk->ntk", own, np.concatenate(z, axis=1))

    def predicted(self, b: int, side: int = 1) -> np.ndarray:
        """n x len x 4: the block's signal without constants, from the calls within reach."""
        first, last = self.reach(b, side)
        lo = self.plan[b][3]
        part = slice(first - lo, last - lo)
        return np.einsum("ts,nsk->ntk", self.phase[b][:, :-2][:, part], self.source(b)[:, part]) @ self.color[b][:, :4].T

    def brighten(self, b: int, wl: float, side: int = 1) -> None:
        """Brightness, of any mean, and weight of each cluster in block b, from how its signal fits the prediction."""
        length = self.plan[b][2]
        y, h = self.own(b) - self.constants(b, True), self.predicted(b, side)
        s = np.clip((h * y).sum(axis=(1, 2)) / np.maximum((h * h).sum(axis=(1, 2)), 1e-12), 0.2, 5)
        err = ((s[:, None, None] * h - y) ** 2).sum(axis=(1, 2)) / (4 * length * max(self.color[b][:, :4].max() ** 2, 1e-12))
        self.w[b] = np.exp(-wl * err)
        self.lam[b] *= s

    def weigh(self, b: int, wl: float, side: int = 1) -> None:
        """brighten, with a mean brightness of 1."""
        self.brighten(b, wl, side)
        self.lam[b] /= self.lam[b].mean()

    def solve(self, blocks: range | list[int], side: int, wl: float, weigh) -> None:
        """New signals and calls of the blocks, then their brightness and weights where weigh(block)."""
        for b in blocks:
            _, start, length, _, _ = self.plan[b]
            z = self.deconvolve(b, side)
            self.out[:, start : start + length] = z
            self.calls[:, start : start + length] = calls_of(z)
        for b in blocks:
            if weigh(b):
                self.weigh(b, wl, side)

    def run(self, rounds: list[Round], fast: bool = False) -> np.ndarray:
        """All blocks' phasing from the old parameters, then all colors, then all signals, round by round. No rounds: the parameters are used as they are."""
        every = range(len(self.plan))
        if rounds:
            self.solve(every, -1, rounds[0].wl, lambda b: True)
        for r in rounds:
            self.phase = [self.fit_phase(b, r.stein, r.extra) for b in every]
            self.color = [self.fit_color(b, r.stein, r.extra) for b in every]
            self.solve(every, 1, r.wl, lambda b, r=r: not r.last or (b == 0 and not fast))
        if not rounds:
            self.solve(every, 1, 0.0, lambda b: False)
        return self.out if fast else neighbour_factor(self.out, self.calls, self.lam)

    def run_serial(self, rounds: list[Round]) -> np.ndarray:
        """The block-by-block variant: each block is fitted with what the blocks before it have just become; brightness follows neighbours at once, and no neighbour factor is taken out."""
        every = range(len(self.plan))
        for i, r in enumerate(rounds):
            for b in every:
                if i == 0:
                    for k in ([b] if b == 0 else []) + ([b + 1] if b + 1 < len(self.plan) else []):
                        if self.fresh:
                            self.phase[k] = infer_phase(self.plan, self.phase, k)
                        self.solve([k], 0, r.wl, lambda b: True)
                self.phase[b] = self.fit_phase(b, r.stein, r.extra)
                self.color[b] = self.fit_color(b, r.stein, r.extra)
                self.solve([b], 1, r.wl, lambda b, r=r: not r.last or b == 0)
        return self.out

    def params(self) -> Params:
        return Params(self.color, self.phase)


def neighbour_ratios(z: np.ndarray, calls: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """4 x 4: the light that a base has after the base before it, from the second cycle's clusters of middling light."""
    mean = z[:, 1].max(axis=1).mean()
    return ratios_of(mean, neighbour_sums(z, calls, lam, mean))


def neighbour_sums(z: np.ndarray, calls: np.ndarray, lam: np.ndarray, mean: float) -> np.ndarray:
    """2 x 4 x 4: the light and the brightness of the clusters of middling light, by their first two bases."""
    top = z[:, 1].max(axis=1)
    use = (top > mean / 2) & (top < 2 * mean)
    pair = 4 * calls[use, 0] + calls[use, 1]
    return np.stack([np.bincount(pair, x[use], 16).reshape(4, 4) for x in (top, lam[0])])


def ratios_of(mean: float, sums: np.ndarray) -> np.ndarray:
    return 0.1 + 0.9 * (mean + sums[0]) / (1 + sums[1])


def neighbour_factor(z: np.ndarray, calls: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """Divide each cycle after the first by the light that its channels have after the base before it."""
    if z.shape[1] < 2:
        return z
    out = z.copy()
    out[:, 1:] /= neighbour_ratios(z, calls, lam)[calls[:, :-1]]
    return out


class ReadError(ValueError):
    """A (tile, end) came with an error from its files."""


class Chain:
    """The chunks of one (tile, end), in order: clusters go in by and by, and each chunk's come out when the next begins."""

    def __init__(self, iterations: int = 4, fast: bool = False, serial: bool = False, block: int = BLOCK):
        self.iterations, self.fast, self.serial, self.block = iterations, fast, serial, block
        self.params: Params | None = None
        self.chunk: int | None = None
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def push(self, ids: np.ndarray, of: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Clusters, their chunks (none before one that has begun) and signals -> clusters and deconvolved signals of chunks that have ended."""
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1), len(of)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                if self.held and self.chunk != int(of[lo]):
                    yield self.solved()
                self.chunk = int(of[lo])
                self.held.append((ids[lo:hi], x[lo:hi]))

    def end(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.held:
            yield self.solved()

    def solved(self) -> tuple[np.ndarray, np.ndarray]:
        ids, x = (np.concatenate([h[i] for h in self.held]) for i in (0, 1))
        self.held.clear()
        work, rounds = Chunk(x, self.params, self.block), schedule(self.chunk, self.iterations, self.fast, self.serial)
        z = work.run_serial(rounds) if self.serial else work.run(rounds, self.fast)
        self.params = work.params()
        if not np.isfinite(z).all():
            raise FloatingPointError(f"chunk {self.chunk} has no finite solution")
        return ids, z


def _chain(iterations: int, fast: bool, serial: bool, block: int, outcomes: bool):
    """The chunks of one (tile, end), in order -> their deconvolved clusters. With outcomes, what goes wrong is a last row without a cluster."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, end_id = (k.as_py() for k in key)
        chain = Chain(iterations, fast, serial, block)
        try:
            for batch in batches:
                if batch.column("error").null_count < batch.num_rows:
                    raise ReadError(batch.column("error").drop_null()[0].as_py())
                ids, of = (np.asarray(batch.column(c)) for c in ("cluster", "chunk"))
                for out in chain.push(ids, of, tensor_of(batch.column("signal"))):
                    yield from batches_of(ROWS, tile, end_id, *out)
            for out in chain.end():
                yield from batches_of(ROWS, tile, end_id, *out)
        except FAULTS as e:
            if not outcomes:
                raise
            for _ in batches:  # the rest of the group
                pass
            yield failure(tile, end_id, e)
    return run


def in_chunks(clusters: DataFrame, most: int | None = None, block: int = BLOCK) -> DataFrame:
    """clusters with their chunk: each (tile, end) is divided by its own numbers of clusters and cycles. most: clusters of a chunk, or below 0 about the number of chunks.

    The numbers come from a window over (tile, end), which deals the rows as the chain needs them: no second scan or shuffle.
    """
    whole = Window.partitionBy("tile", "end_id")
    sized = clusters.withColumns({"total": F.count("*").over(whole), "cycles": F.max(F.size("signal")).over(whole)})
    size = F.lit(most) if most and most > 0 else F.floor(F.col("total") / -most) + 2 if most else chunk_size(F.ceil(F.col("cycles") / block), block)
    sized = sized.withColumn("chunks", F.greatest(F.ceil(F.col("total") / size), F.lit(1)).cast("int"))
    return sized.withColumn("chunk", chunk_of(F.col("cluster"), F.col("total"), F.col("chunks"))).drop("total", "cycles")


def basecall(clusters: DataFrame, iterations: int = 4, fast: bool = False, most: int | None = None, serial: bool = False, block: int = BLOCK, outcomes: bool = False) -> DataFrame:
    """clusters (tile, end_id, cluster, signal) -> the same with deconvolved signals. All clusters of a tile have as many cycles and are numbered from 0.

    Chunks of a (tile, end) run one after another, as each starts from the parameters of the one before: the rows are dealt by
    (tile, end), sorted by chunk and cluster, and streamed, in one scan and one shuffle. A lost task begins its (tile, end) again.
    outcomes: a (tile, end) that can't be solved, or has a row with an error in a column of that name, doesn't end the job but gives
    a row with a null cluster and what is wrong in the further column error; rows of chunks before the faulty one may be there, too.
    """
    iterations = 3 if fast and iterations == 4 else iterations
    error = F.col("error") if "error" in clusters.columns else F.lit(None).cast("string")
    data = in_chunks(clusters.select("tile", "end_id", "cluster", "signal", error.alias("error")), most, block)
    data = data.sortWithinPartitions("tile", "end_id", "chunk", "cluster").select("tile", "end_id", "cluster", "chunk", "signal", "error")  # null clusters first
    chain = _chain(iterations, fast, serial, block, outcomes)
    out = data.groupBy("tile", "end_id").applyInArrow(chain, ROWS_DDL)
    return out if outcomes else out.drop("error")
