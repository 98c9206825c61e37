"""Estimation of one chunk that is spread over many tasks.

The clusters stay where they are, with their calls, brightness and weights. A fit needs sums over clusters alone: each task adds up
its partial Gram matrices, these are added up in a tree, and the driver solves systems of a block's size. So a chunk isn't bounded by
a task: it may be a whole tile, as the method's fits see it best, or all tiles of a run. Results are those of estimate.Chunk but for
the order of sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewright.operators import estimate
from basewright.operators.blocks import BLOCK, block_plan
from basewright.operators.estimate import CENTROIDS, Chunk, Params, Round
from basewright.operators.state import kept
from basewright.operators.tensor import signals_of, tensor_of

#: Tasks of the upper level of a sum's tree.
BRANCHES = 16
_STATE = "cluster int, place long, signal array<array<double>>, lam array<double>, w array<double>, calls array<int>"


def added(rows: DataFrame, f: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of f over all batches of rows: within tasks, in BRANCHES tasks, then here."""
    one = lambda x: pa.RecordBatch.from_arrays([pa.array([x.tolist()], pa.list_(pa.float64()))], names=["s"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += f(b)
        yield one(total)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            total += np.asarray(b.column(0).flatten()).reshape(b.num_rows, size).sum(axis=0)
        yield one(total)

    parts = rows.mapInArrow(part, "s array<double>").repartition(BRANCHES).mapInArrow(whole, "s array<double>")
    return np.sum([r.s for r in parts.collect()], axis=0)  # BRANCHES rows


def _firsts(b: pa.RecordBatch) -> np.ndarray:
    return tensor_of(b.column("signal"))[:, 0]


def color_seed(rows: DataFrame, rounds: int = 5) -> np.ndarray:
    """estimate.color_seed over all rows (signal): each assignment is a pass that adds up classes."""
    mean = added(rows, lambda b: np.array([np.linalg.norm(_firsts(b), axis=1).sum(), b.num_rows]), 2)
    limit = mean[0] / max(mean[1], 1) / 2

    def bright(b: pa.RecordBatch) -> np.ndarray:
        x = _firsts(b)
        return x[np.linalg.norm(x, axis=1) > limit]

    def classes(c: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Sums and numbers of each class's members that near(members, class) takes: 4 x 5."""
        def f(b: pa.RecordBatch) -> np.ndarray:
            x = bright(b)
            k = estimate.nearest(x, c)[0]
            out = np.zeros((4, 5))
            for j in range(4):
                use = near(x[k == j], j)
                out[j] = [*use.sum(axis=0), len(use)]
            return out.reshape(-1)
        return added(rows, f, 20).reshape(4, 5)

    c = last = CENTROIDS.copy()
    seen = 0
    for _ in range(rounds):
        last, sums = c, classes(c, lambda x, j: x)
        seen = sums[:, 4].sum()
        if not seen:
            return np.hstack([c.T, np.zeros((4, 1))])
        c = np.where(sums[:, 4:] > 0, sums[:, :4] / np.maximum(sums[:, 4:], 1), c)
        if np.linalg.norm(c - last) < np.linalg.norm(last) / 1e4:
            break
    limit_cos, moved = 0.2, c
    for _ in range(2):  # trimming keeps the classes of the last assignment
        sums = classes(last, lambda x, j, m=moved, t=limit_cos: x[1 - estimate.nearest(x, m[j][None])[1][:, 0] < t])
        moved = np.where(sums[:, 4:] > 2, moved + 1.25 * (sums[:, :4] / np.maximum(sums[:, 4:], 1) - moved), moved)
        limit_cos = limit_cos**2 * 3
    return estimate.with_background(moved)


class Spread:
    """One chunk's state, spread; rows (cluster, signal), all of as many cycles."""

    def __init__(self, rows: DataFrame, params: Params | None = None, block: int = BLOCK):
        """A cluster's place is its number less the least one."""
        self.block = block
        first = rows.agg(F.min("cluster").alias("m"), F.max(F.size("signal")).alias("cycles")).first()
        self.plan = block_plan(first.cycles, block)
        ones = F.array_repeat(F.lit(1.0), len(self.plan))
        state = rows.select(F.col("cluster").cast("int").alias("cluster"), (F.col("cluster") - first.m).cast("long").alias("place"), "signal", ones.alias("lam"), ones.alias("w"), F.array_repeat(F.lit(0), first.cycles).alias("calls"))
        self.rows = kept(state)
        if params is None:
            color = color_seed(self.rows)
            params = Params([color.copy() for _ in self.plan], estimate.phase_seed(self.plan))
        self.color, self.phase = list(params.color), list(params.phase)
        self.scale = np.linalg.norm(np.diag(self.color[0][:, :4])) / 2
        self.mean = np.ones(len(self.plan))  # of the brightness that rows hold

    def _part(self) -> Callable[[pa.RecordBatch], Chunk]:
        """What makes a batch a part of the chunk as it stands now."""
        params, scale, mean, block = Params(self.color, self.phase), self.scale, self.mean, self.block

        def part(b: pa.RecordBatch) -> Chunk:
            work = Chunk(tensor_of(b.column("signal")), params, block)
            n = b.num_rows
            work.scale, work.index = scale, np.asarray(b.column("place"))
            flat = lambda c: np.array(b.column(c).flatten()).reshape(n, -1)
            work.lam, work.w, work.calls = flat("lam").T / mean[:, None], flat("w").T.copy(), flat("calls").astype(int)
            return work
        return part

    def _fitted(self, sums: str, fit: str, r: Round, outputs: Callable[[int], tuple[int, int]]) -> list[np.ndarray]:
        """All blocks' fits from the sums of all parts. outputs: regressors and outputs of a block."""
        part, blocks = self._part(), range(len(self.plan))

        def f(b: pa.RecordBatch) -> np.ndarray:
            work = part(b)
            return np.concatenate([np.concatenate([g.reshape(-1), y.reshape(-1), [w]]) for g, y, w in (getattr(work, sums)(k) for k in blocks)])

        shapes = [outputs(k) for k in blocks]
        sizes = [n * n + n * m + 1 for n, m in shapes]
        total, at, out = added(self.rows, f, sum(sizes)), 0, []
        whole = Chunk(np.zeros((1, sum(p[2] for p in self.plan), 4)), Params(self.color, self.phase), self.block)
        whole.scale = self.scale
        for k, (n, m) in enumerate(shapes):
            x = total[at : at + sizes[k]]
            at += sizes[k]
            out.append(getattr(whole, fit)(k, r.stein, r.extra, (x[: n * n].reshape(n, n), x[n * n : -1].reshape(n, m), x[-1])))
        return out

    def _solved(self, side: int, wl: float, weigh: Callable[[int], bool], last: bool = False) -> DataFrame:
        """New calls of all blocks, brightness and weights of those that weigh takes; last: the deconvolved signals are kept in the signals' place."""
        part, blocks = self._part(), [(b, weigh(b)) for b in range(len(self.plan))]
        mean = self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                work = part(b)
                work.solve([k for k, _ in blocks], side, wl, lambda k: False)
                for k, on in blocks:
                    if on:
                        work.brighten(k, wl, side)
                lam = np.where(np.array([on for _, on in blocks])[:, None], work.lam, work.lam * mean[:, None])
                lists = [pa.array(x.tolist()) for x in (lam.T, work.w.T, work.calls.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([b.column("cluster"), b.column("place"), signals_of(work.out) if last else b.column("signal"), lists[0], lists[1], lists[2].cast(pa.list_(pa.int32()))], names=["cluster", "place", "signal", "lam", "w", "calls"])

        rows = kept(self.rows.mapInArrow(run, _STATE))
        if any(on for _, on in blocks):
            new = rows.agg(*[F.avg(F.col("lam")[k]).alias(f"m{k}") for k, _ in blocks]).first()
            self.mean = np.array([new[k] if on else mean[k] for k, on in blocks])
        self.rows = rows
        return rows

    def run(self, rounds: list[Round], fast: bool = False) -> DataFrame:
        """As Chunk.run: cluster, signal, deconvolved."""
        if rounds:
            self._solved(-1, rounds[0].wl, lambda b: True)
        for r in rounds:
            size = lambda b: self.plan[b][4] + 2
            self.phase = self._fitted("phase_sums", "fit_phase", r, lambda b: (size(b), self.plan[b][2]))
            self.color = self._fitted("color_sums", "fit_color", r, lambda b: (5, 4))
            self._solved(1, r.wl, lambda b, r=r: not r.last or (b == 0 and not fast), r.last)
        if not rounds:
            self._solved(1, 0.0, lambda b: False, True)
        return self.rows.select("cluster", "signal") if fast else self._without_neighbours()

    def _without_neighbours(self) -> DataFrame:
        cycles = sum(p[2] for p in self.plan)
        if cycles < 2:
            return self.rows.select("cluster", "signal")
        lam_mean = self.mean[0]
        state = lambda b: (tensor_of(b.column("signal")), np.array(b.column("calls").flatten()).reshape(b.num_rows, -1), np.array(b.column("lam").flatten()).reshape(b.num_rows, -1).T / lam_mean)
        top = added(self.rows, lambda b: np.array([state(b)[0][:, 1].max(axis=1).sum(), b.num_rows]), 2)
        mean = top[0] / max(top[1], 1)
        f = estimate.ratios_of(mean, added(self.rows, lambda b: estimate.neighbour_sums(*state(b), mean).reshape(-1), 32).reshape(2, 4, 4))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    z, calls, _ = state(b)
                    z = z.copy()
                    z[:, 1:] /= f[calls[:, :-1]]
                    yield pa.RecordBatch.from_arrays([b.column("cluster"), signals_of(z)], names=["cluster", "signal"])
        return self.rows.mapInArrow(run, "cluster int, signal array<array<double>>")

    def params(self) -> Params:
        return Params(self.color, self.phase)
