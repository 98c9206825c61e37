"""Signals between Arrow and numpy: the values of a column lie in one flat buffer, which a kernel sees as an array of its shape."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Clusters of a batch that goes out.
CLUSTERS_A_BATCH = 4096
SIGNAL = pa.list_(pa.list_(pa.float64()))


def tensor_of(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """A column of signals of one shape as clusters x cycles x 4, without a copy where it is one piece."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().flatten()
    n = len(column)
    if column.null_count or values.null_count or n and len(values) % (4 * n):
        raise ValueError("signals are null or of unlike lengths")
    cycles = len(values) // (4 * n) if n else 0
    if (np.diff(np.asarray(column.offsets)) != cycles).any() or (np.diff(np.asarray(column.flatten().offsets)) != 4).any():
        raise ValueError("signals are of unlike lengths")
    return np.asarray(values, float).reshape(n, cycles, 4)


def signals_of(x: np.ndarray) -> pa.ListArray:
    """clusters x cycles x channels as a column of signals, by offsets alone."""
    n, cycles, channels = x.shape
    inner = pa.ListArray.from_arrays(pa.array(np.arange(n * cycles + 1, dtype=np.int32) * channels), pa.array(np.ascontiguousarray(x, float).reshape(-1)))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * cycles), inner)


def batches_of(schema: pa.Schema, tile: str | None, end_id: int | None, clusters: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (tile, end_id, cluster, signal, error), the last one null."""
    for at in range(0, len(clusters), CLUSTERS_A_BATCH):
        ids = clusters[at : at + CLUSTERS_A_BATCH]
        yield pa.RecordBatch.from_arrays([pa.array([tile] * len(ids), pa.string()), pa.array([end_id] * len(ids), pa.int32()), pa.array(ids, pa.int32()), signals_of(x[at : at + CLUSTERS_A_BATCH]), pa.nulls(len(ids), pa.string())], schema=schema)


#: Rows of clusters; one with an error in place of a signal stands for its whole (tile, end).
ROWS = pa.schema([("tile", pa.string()), ("end_id", pa.int32()), ("cluster", pa.int32()), ("signal", SIGNAL), ("error", pa.string())])
ROWS_DDL = "tile string, end_id int, cluster int, signal array<array<double>>, error string"


def failure(tile: str | None, end_id: int | None, error: Exception) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([tile], pa.string()), pa.array([end_id], pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, SIGNAL), pa.array([f"{type(error).__name__}: {error}"])], schema=ROWS)


#: What a kernel may raise over one (tile, end)'s values.
FAULTS = (ValueError, ArithmeticError, np.linalg.LinAlgError)
