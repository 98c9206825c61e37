"""Intensity files as a Spark data source: spark.read.format("intensities").

A partition is a range of clusters of one file. It reads only the pieces of the planes that its clusters and the asked cycles need,
so files may be of any size, and a task holds partitionBytes of them.

Options:
    path            a file, a folder, or a pattern in the last part of the path
    layout          reads (default): tile, cluster, signal; cycles: tile, cluster, cycle (from 1), v
    cycles          first,last from 1; a range beyond the file takes all from its first on
    clusters        first,count from 0; likewise
    folders         true: one file for each cycle, C{n}.1/<tile>.cif below path; needs cycles; a missing cycle is a plane of zeros
    compat          true: width 3 is int32
    mode            FAILFAST (default): a bad file ends the query; PERMISSIVE: it gives one row with its tile, nulls, and what is
                    wrong in the further column error
    partitionBytes  bytes of a file that a task reads at most (32 MB)
    partitionClusters  clusters, likewise

Filters on tile, cluster and cycle (comparisons, IN, the beginning of a tile's name) reach the files: other files, planes and clusters
aren't read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
    StringStartsWith,
)

from basewright.operators.tensor import signals_of
from basewright.sources import store

HEADER, WIDTHS = 13, {1: "<i1", 2: "<i2", 4: "<i4"}
CLUSTERS_A_BATCH = 4096


def cif_header(data: bytes, compat: bool = False) -> tuple[int, int, int, int]:
    """(bytes per value, first cycle, cycles, clusters); compat takes width 3 as int32."""
    if data[:3] != b"CIF" or len(data) < HEADER:
        raise ValueError("not a CIF file")
    width, first, cycles, clusters = data[4], *struct.unpack_from("<HHI", data, 5)
    width = 4 if compat and width == 3 else width
    if width not in WIDTHS:
        raise ValueError(f"{width} bytes a value")
    return width, first, cycles, clusters


def taken(first: int, count: int | None, there: int) -> tuple[int, int]:
    """First and number of what a range asks for of so many; a range that ends beyond them takes all from its first on."""
    if first > there:
        raise ValueError(f"a range begins at {first + 1} of {there}")
    return first, count if count is not None and first + count <= there else there - first


@dataclass
class Piece(InputPartition):
    """Clusters [at, at + n) of a tile: of one file that holds all cycles, or of a file for each."""

    tile: str
    files: list[tuple[int, str | None]] = field(default_factory=list)  # (cycle from 0, its file); a null file is a plane of zeros
    width: int = 2
    total: int = 0
    at: int = 0
    n: int = 0
    whole: bool = True  # all cycles in each file
    error: str | None = None


def _range(options: dict, name: str) -> tuple[int, int] | None:
    text = options.get(name)
    if not text:
        return None
    a, b = (int(x) for x in text.split(","))
    return a, b


def _yes(options: dict, name: str) -> bool:
    return options.get(name, "false").lower() == "true"


class IntensityReader(DataSourceReader):
    """Plans and reads pieces of files."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.long = options.get("layout", "reads") == "cycles"
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.bytes = int(options.get("partitionbytes", 32 << 20))
        self.most = int(options.get("partitionclusters", 1 << 31))
        self.compat, self.folders = _yes(options, "compat"), _yes(options, "folders")
        cycles = _range(options, "cycles")
        self.cycles = (cycles[0] - 1, cycles[1] - cycles[0] + 1) if cycles else (0, None)
        self.clusters = _range(options, "clusters") or (0, None)
        if "path" not in options:
            raise ValueError("intensities need a path")
        if self.folders and not cycles:
            raise ValueError("folders need cycles")
        if min(self.cycles[0], self.clusters[0]) < 0 or any(n is not None and n < 1 for n in (self.cycles[1], self.clusters[1])):
            raise ValueError("cycles are first,last from 1 and clusters first,count from 0")
        self.low = {"cluster": 0, "cycle": 1}
        self.high: dict[str, int] = {}
        self.tiles: set | None = None
        self.starts: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "tile" and isinstance(f, EqualTo | In) or name == "tile" and isinstance(f, StringStartsWith):
                if isinstance(f, StringStartsWith):
                    self.starts.append(f.value)
                else:
                    wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                    self.tiles = wanted if self.tiles is None else self.tiles & wanted
            elif name == "cluster" or name == "cycle" and self.long:
                if isinstance(f, IsNotNull):
                    if self.permissive:  # an error's row has nulls
                        yield f
                elif not self._bounded(name, f):
                    yield f
            else:
                yield f

    def _bounded(self, name: str, f: Filter) -> bool:
        """Whether the filter is a range, which is then kept."""
        v = getattr(f, "value", None)
        if not isinstance(v, int) or isinstance(v, bool):
            return False
        if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
            self.low[name] = max(self.low[name], v + isinstance(f, GreaterThan))
        if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
            self.high[name] = min(self.high.get(name, v), v - isinstance(f, LessThan))
        return isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual)

    def _asked(self, tile: str) -> bool:
        return (self.tiles is None or tile in self.tiles) and all(tile.startswith(s) for s in self.starts)

    def _head(self, path: str, size: int | None) -> tuple[int, int, int]:
        """(width, cycles, clusters) of a file that holds as much as its header says."""
        if size is None:
            raise ValueError("no such file")
        with store.opened(path) as f:
            width, _, cycles, clusters = cif_header(f.read(HEADER), self.compat)
        if size < HEADER + 4 * width * cycles * clusters:
            raise ValueError(f"{size} bytes, {HEADER + 4 * width * cycles * clusters} expected")
        return width, cycles, clusters

    def _planned(self, tile: str, path: str, size: int | None, files: list[tuple[int, str | None]] | None) -> list[Piece]:
        """The pieces of a tile: of the file at path, or of a file for each cycle, of which path is the first."""
        try:
            width, cycles, clusters = self._head(path, size)
            first, count = taken(*self.clusters, clusters)
            if files is None:
                begin, n = taken(*self.cycles, cycles)
                files = [(c, path) for c in range(begin, begin + n)]
        except (ValueError, OSError) as e:
            return [Piece(tile, error=f"{path}: {e}")]
        files = [(c, p) for c, p in files if self.low["cycle"] <= c + 1 <= self.high.get("cycle", c + 1)] if self.long else files
        lo, hi = max(first, self.low["cluster"]), min(first + count, self.high.get("cluster", first + count) + 1)
        step = max(min(self.bytes // max(4 * width * len(files), 1), self.most), 1)
        whole = Piece(tile, files, width, clusters, whole=not self.folders)
        return [replace(whole, at=at, n=min(step, hi - at)) for at in range(lo, hi, step)] if files or not self.long else []

    def _in_folders(self) -> list[tuple[str, str, int | None, list[tuple[int, str | None]]]]:
        """(tile, first cycle's file, its bytes, every cycle's file) of each tile that has any asked cycle."""
        first, n = self.cycles
        found: dict[str, dict[int, tuple[str, int]]] = {}
        for path, size in store.listed(self.options["path"], ".cif", deep=True):
            if m := re.search(r"(?:^|/)C(\d+)\.1/([^/]+)\.cif$", path):
                found.setdefault(m[2], {})[int(m[1]) - 1] = (path, size)
        out = []
        for tile, at in sorted(found.items()):
            cycles = range(first, first + n)
            if any(c in at for c in cycles) and self._asked(tile):
                head = next(c for c in cycles if c in at)
                out.append((tile, *at[head], [(c, at[c][0] if c in at else None) for c in cycles]))
        return out

    def partitions(self) -> Sequence[InputPartition]:
        if self.folders:
            tiles = self._in_folders()
        else:
            tiles = [(path.rpartition("/")[2].removesuffix(".cif"), path, size, None) for path, size in store.listed(self.options["path"], ".cif")]
            tiles = [t for t in tiles if self._asked(t[0])]
        with ThreadPoolExecutor(16) as pool:  # headers alone
            pieces = [p for out in pool.map(lambda t: self._planned(*t), tiles) for p in out]
        if not self.permissive and (bad := [p.error for p in pieces if p.error]):
            raise ValueError("; ".join(bad[:5]))
        return pieces or [Piece("")]

    def _planes(self, p: Piece) -> np.ndarray:
        """cycles x 4 x clusters of the piece."""
        x = np.zeros((len(p.files), 4, p.n), WIDTHS[p.width])
        open_path, f = None, None
        for k, (cycle, path) in enumerate(p.files):
            if path is None:
                continue
            if path != open_path:
                if f:
                    f.close()
                open_path, f = path, store.opened(path)
                if not p.whole:
                    width, _, _, clusters = cif_header(f.read(HEADER), self.compat)
                    if (width, clusters) != (p.width, p.total):
                        raise ValueError(f"{path}: {width} bytes a value and {clusters} clusters, {p.width} and {p.total} in the first cycle")
            for channel in range(4):
                plane = 4 * cycle * p.whole + channel
                f.seek(HEADER + p.width * (plane * p.total + p.at))
                got = f.read(p.width * p.n)
                if len(got) < p.width * p.n:
                    raise ValueError(f"{path} ends early")
                x[k, channel] = np.frombuffer(got, WIDTHS[p.width])
        if f:
            f.close()
        return x

    def _batch(self, tile: str, clusters: np.ndarray | None, x: np.ndarray | None, cycles: list[int], error: str | None = None) -> pa.RecordBatch:
        """Rows of clusters x cycles x 4 values, or one row with an error."""
        n, k = (len(clusters), len(cycles)) if clusters is not None else (1, 0)
        rows = n * k if self.long and clusters is not None else n
        if clusters is None:
            cols = [pa.array([tile]), pa.nulls(1, pa.int32()), *[pa.nulls(1, pa.int32())] * self.long, pa.nulls(1, pa.list_(pa.float64()) if self.long else pa.list_(pa.list_(pa.float64())))]
        else:
            v = signals_of(x)
            ids = pa.array(np.repeat(clusters, k) if self.long else clusters, pa.int32())
            at = [pa.array(np.tile(np.array(cycles, np.int32) + 1, n))] if self.long else []
            cols = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(rows, np.int32)), [tile]).dictionary_decode(), ids, *at, v.flatten() if self.long else v]
        names = ["tile", "cluster", *["cycle"] * self.long, "v" if self.long else "signal"]
        if self.permissive:
            cols, names = [*cols, pa.array([error] * rows, pa.string())], [*names, "error"]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition.error:
            yield self._batch(partition.tile, None, None, [], partition.error)
            return
        if not partition.n:
            return
        try:
            x = self._planes(partition)
        except (ValueError, OSError) as e:
            if not self.permissive:
                raise
            yield self._batch(partition.tile, None, None, [], str(e))
            return
        cycles = [c for c, _ in partition.files]
        step = max(CLUSTERS_A_BATCH // (max(len(cycles), 1) if self.long else 1), 1)
        for at in range(0, partition.n, step):
            part = np.ascontiguousarray(x[:, :, at : at + step].transpose(2, 0, 1), float)
            yield self._batch(partition.tile, np.arange(partition.at + at, partition.at + at + len(part), dtype=np.int32), part, cycles)


class IntensitySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "intensities"

    def schema(self) -> str:
        layout = self.options.get("layout", "reads")
        if layout not in ("reads", "cycles"):
            raise ValueError(f"layout {layout}: there are reads and cycles")
        rows = "tile string, cluster int, cycle int, v array<double>" if layout == "cycles" else "tile string, cluster int, signal array<array<double>>"
        return rows + (", error string" if self.options.get("mode", "FAILFAST").upper() == "PERMISSIVE" else "")

    def reader(self, schema) -> IntensityReader:
        return IntensityReader({k.lower(): v for k, v in self.options.items()})


def registered(spark: SparkSession) -> SparkSession:
    """The session with this source known and filters handed to it."""
    spark.dataSource.register(IntensitySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark
