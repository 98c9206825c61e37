"""The engine in SQL: table functions over tables of signals, and the data sources, registered by one function.

    SELECT * FROM basecall(TABLE(signals))
    SELECT * FROM deconvolve(TABLE(chunked) PARTITION BY (tile, end_id) ORDER BY (chunk, cluster))
    SELECT * FROM correct(TABLE(striped) PARTITION BY (tile, end_id, stripe))

basecall takes tile, end_id, cluster and signal; chunked and striped are views of such a table, made by chunked_view and striped_view.
The functions run the kernels that the DataFrame functions run, batch by batch: deconvolve holds one chunk, correct one stripe.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.operators import spatial
from basewright.operators.estimate import Chain, in_chunks
from basewright.operators.tensor import ROWS, batches_of, tensor_of
from basewright.sources import files, intensities

_BASES = np.array(list("ACGT"))
_PLAIN = ROWS.remove(4)


class Basecall:
    """Each read's bases: the channel of the largest value of each cycle, the first of equals."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        if batch.num_rows:
            bases = _BASES[tensor_of(batch.column("signal")).argmax(axis=2)]
            yield pa.table({"tile": batch.column("tile"), "end_id": batch.column("end_id"), "cluster": batch.column("cluster"), "seq": pa.array(["".join(r) for r in bases], pa.string())})


class Deconvolve:
    """The chunks of one (tile, end), which are the partition, in order of chunk and cluster."""

    def __init__(self):
        self.chain, self.key = Chain(), None

    def _rows(self, found) -> Iterator[pa.Table]:
        for out in found:
            yield pa.Table.from_batches([b.drop_columns(["error"]) for b in batches_of(ROWS, *self.key, *out)], _PLAIN)

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        if batch.num_rows:
            self.key = tuple(batch.column(c)[0].as_py() for c in ("tile", "end_id"))
            ids, of = (np.asarray(batch.column(c)) for c in ("cluster", "chunk"))
            yield from self._rows(self.chain.push(ids, of, tensor_of(batch.column("signal"))))

    def terminate(self) -> Iterator[pa.Table]:
        yield from self._rows(self.chain.end())


class Correct:
    """One stripe with its halo, which is the partition: the core's signals without the light of neighbours."""

    def __init__(self):
        self.held: list[pa.RecordBatch] = []

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        self.held.append(batch)
        yield pa.Table.from_batches([], _PLAIN)

    def terminate(self) -> Iterator[pa.Table]:
        rows = pa.Table.from_batches(self.held) if self.held else None
        if rows is not None and rows.num_rows:
            rows = rows.sort_by("cluster")
            key = tuple(rows.column(c)[0].as_py() for c in ("tile", "end_id"))
            ids, x = spatial.stripe_solved(rows, np.array(rows.column("w")[0].as_py(), float), rows.column("thr")[0].as_py())
            yield pa.Table.from_batches([b.drop_columns(["error"]) for b in batches_of(ROWS, *key, ids, x)], _PLAIN)


def chunked_view(signals: DataFrame, name: str, most: int | None = None) -> None:
    """A view of signals (tile, end_id, cluster, signal) with the chunk of each cluster, for deconvolve."""
    in_chunks(signals.select("tile", "end_id", "cluster", "signal"), most).drop("chunks").createOrReplaceTempView(name)


def striped_view(signals: DataFrame, loc: DataFrame, name: str) -> None:
    """A view of signals with their places (loc: tile, cluster, x, y), a row for each stripe whose core or halo holds a cluster, for correct."""
    rows, limits = spatial.placed_rows(signals, signals, loc)
    rows.join(F.broadcast(limits), ["tile", "end_id", "stripe"]).createOrReplaceTempView(name)  # a row for each stripe


def registered(spark: SparkSession) -> SparkSession:
    """The session with basecall, deconvolve and correct, and the data sources intensities and files."""
    rows = "tile string, end_id int, cluster int, "
    for name, kind, more in (("basecall", Basecall, "seq string"), ("deconvolve", Deconvolve, "signal array<array<double>>"), ("correct", Correct, "signal array<array<double>>")):
        spark.udtf.register(name, F.arrow_udtf(kind, returnType=rows + more))
    return files.registered(intensities.registered(spark))
