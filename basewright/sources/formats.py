"""Readers and writers of the native formats.

Intensities are read by the data source `intensities` from stores that pyarrow knows, or by Spark's binary reader from any other
(one file a row, under 2 GB). All files are written by the data source `files`, whole or not at all.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from basewright.functions import expr as E
from basewright.sources.files import write_files
from basewright.sources.intensities import CLUSTERS_A_BATCH, HEADER, WIDTHS, cif_header, registered, taken

#: Clusters of a piece of a plane that is written.
CLUSTERS_A_PIECE = 4096


def cif_bytes(values: np.ndarray, first: int = 1) -> bytes:
    """values: cycles x 4 x clusters of int16."""
    cycles, _, clusters = values.shape
    return b"CIF" + bytes([1, 2]) + struct.pack("<HHI", first, cycles, clusters) + values.astype("<i2").tobytes()


def _decoded(compat: bool, begin: int, count: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for path, data in zip(d["path"], d["content"], strict=True):
                width, _, cycles, clusters = cif_header(data, compat)
                lo, n = taken(begin, count, cycles)
                x = np.frombuffer(data, WIDTHS[width], cycles * 4 * clusters, HEADER).reshape(cycles, 4, clusters)[lo : lo + n]
                for at in range(0, clusters, CLUSTERS_A_BATCH):
                    part = x[:, :, at : at + CLUSTERS_A_BATCH].transpose(2, 0, 1).astype(float)
                    yield pd.DataFrame({"path": path, "cluster": np.arange(at, at + len(part), dtype=np.int32), "signal": [s.tolist() for s in part]})
    return run


def _stem(suffix: str):
    return F.regexp_extract("path", rf"([^/]+){suffix}$", 1)


def read_cif(spark: SparkSession, path: str, cycles: tuple[int, int] | None = None, compat: bool = False) -> DataFrame:
    """tile, cluster, signal of each file; cycles: the first and last wanted, from 1."""
    begin, count = (cycles[0] - 1, cycles[1] - cycles[0] + 1) if cycles else (0, None)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.cif").load(path).select("path", "content")
    return files.mapInPandas(_decoded(compat, begin, count), "path string, cluster int, signal array<array<double>>").select(_stem(r"\.cif").alias("tile"), "cluster", "signal")


def read_cif_folders(spark: SparkSession, path: str, first: int, last: int, compat: bool = False) -> DataFrame:
    """One file for each cycle, C{n}.1/<tile>.cif; a missing cycle is a plane of zeros."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.cif").option("recursiveFileLookup", "true").load(path).select("path", "content")
    one = files.mapInPandas(_decoded(compat, 0, None), "path string, cluster int, signal array<array<double>>")
    one = one.select(_stem(r"\.cif").alias("tile"), F.regexp_extract("path", r"/C(\d+)\.1/[^/]+$", 1).cast("int").alias("cycle"), "cluster", F.col("signal")[0].alias("v")).where(F.col("cycle").between(first, last))
    have = one.groupBy("tile", "cluster").agg(F.map_from_entries(F.collect_list(F.struct("cycle", "v"))).alias("m"))
    zero = F.array_repeat(F.lit(0.0), 4)
    return have.select("tile", "cluster", F.transform(F.sequence(F.lit(first), F.lit(last)), lambda c: F.coalesce(F.try_element_at("m", c), zero)).alias("signal"))


def read_intensities(spark: SparkSession, path: str, cycles: tuple[int, int] | None = None, folders: bool = False, **options: str) -> DataFrame:
    """The data source `intensities`: files of any size, by ranges of clusters. options as there, such as layout, mode, clusters and compat."""
    if cycles:
        options["cycles"] = f"{cycles[0]},{cycles[1]}"
    return registered(spark).read.format("intensities").options(folders=str(folders).lower(), **options).load(path)


def read_cif_ranges(spark: SparkSession, path: str, clusters: int = 50_000, cycles: tuple[int, int] | None = None, compat: bool = False) -> DataFrame:
    """read_intensities with so many clusters a task at most."""
    return read_intensities(spark, path, cycles, partitionClusters=str(clusters), compat=str(compat).lower())


def output_name(tile: str, prefix: str = "", suffix: str = "", end: int | None = None, inner: bool = False) -> str:
    """A result's name without its folder and extension: the end's number where a run has several, `inner` for the inner tensor."""
    return prefix + tile + suffix + ("_inner" if inner else "" if end is None else f"_end{end}")


_PIECES = pa.schema([("tile", pa.string()), ("cycle", pa.int32()), ("channel", pa.int32()), ("piece", pa.int32()), ("data", pa.binary())])


def _planes(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Clusters of one (tile, piece), in order -> their part of each plane."""
    values = []
    for batch in batches:
        flat = batch.column("values").flatten()
        values.append(np.asarray(flat, np.int16).reshape(batch.num_rows, -1))
    x = np.concatenate(values).astype("<i2")
    n = x.shape[1]
    at = np.arange(n, dtype=np.int32)
    tile, piece = (k.as_py() for k in key)
    yield pa.RecordBatch.from_arrays([pa.array([tile] * n), pa.array(at // 4), pa.array(at % 4), pa.array([piece] * n, pa.int32()), pa.array([x[:, k].tobytes() for k in at], pa.binary())], schema=_PIECES)


def write_cif(signals: DataFrame, path: str, prefix: str = "", suffix: str = "", first: int = 0, folders: bool = False, scale: bool | None = None) -> list[str]:
    """Write signals (tile, cluster, signal) as intensity files of int16 and return their paths.

    folders: one file for each cycle, C{n}.1/<tile>.cif with n from first + 1 on, else one file a tile. Values in unit scale, tile
    by tile (scale: so or not for all), are written times 4000. Clusters are written in their order; numbers may be left out, but not
    twice there. Planes are cut into pieces of CLUSTERS_A_PIECE numbers, made side by side, and a file is one task's work, piece by
    piece. All clusters of a tile have as many cycles.
    """
    flat = F.flatten("signal")
    big = F.aggregate(flat, F.lit(0), lambda a, x: a + (F.abs(x) > 10).cast("int"))
    unit = F.sum(big) < 0.5 * F.sum(F.size(flat)) if scale is None else F.first(F.lit(scale))
    tiles = signals.groupBy("tile").agg(F.when(unit, 4000.0).otherwise(1.0).alias("factor"), F.count("*").alias("clusters"), F.max(F.size("signal")).alias("cycles"))
    tiles = F.broadcast(tiles)  # a row for each file
    rows = signals.join(tiles, "tile").select("tile", F.floor(F.col("cluster") / CLUSTERS_A_PIECE).cast("int").alias("piece"), "cluster", F.transform(flat, lambda x: E.quantise(x, F.col("factor"))).cast("array<short>").alias("values"))
    rows = rows.repartition("tile", "piece").sortWithinPartitions("tile", "piece", "cluster")
    pieces = rows.groupBy("tile", "piece").applyInArrow(_planes, "tile string, cycle int, channel int, piece int, data binary")
    name = F.concat(F.lit(prefix), "tile", F.lit(suffix + ".cif"))
    if folders:
        name = F.concat(F.lit("C"), (F.col("cycle") + first + 1).cast("string"), F.lit(".1/"), name)
    heads = tiles.select("tile", F.explode(F.sequence(F.lit(0), F.col("cycles") - 1 if folders else F.lit(0)).cast("array<int>")).alias("cycle"), "clusters", (F.lit(1) if folders else F.col("cycles")).alias("n"))
    little = lambda c, size: F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(c, 8 * i).bitwiseAND(F.lit(255))), 2, "0")) for i in range(size)])
    head = F.concat(F.lit(b"CIF\x01\x02"), little(F.lit(1).cast("long"), 2), little(F.col("n").cast("long"), 2), little(F.col("clusters"), 4))
    heads = heads.select(name.alias("name"), F.lit(-1).alias("cycle"), F.lit(0).alias("channel"), F.lit(0).alias("piece"), head.alias("data"))
    return write_files(heads.unionByName(pieces.select(name.alias("name"), "cycle", "channel", "piece", "data")), path, "cycle", "channel", "piece")


def _clocs(data: bytes) -> np.ndarray:
    at, block, out = 5, 0, []
    while at < len(data):
        n = data[at]
        xy = np.frombuffer(data, np.uint8, 2 * n, at + 1).reshape(n, 2) / 10.0
        out.append(xy + [block % 82 * 25, block // 82 * 25])
        at, block = at + 1 + 2 * n, block + 1
    return np.concatenate(out) if out else np.empty((0, 2))


def _locs(data: bytes) -> np.ndarray:
    one, scale, n = struct.unpack_from("<ifi", data)
    if one != 1 or scale != 1.0:
        raise ValueError("not a locs file")
    return np.frombuffer(data, "<f4", 2 * n, 12).reshape(n, 2).astype(float)


def _pos(data: bytes) -> np.ndarray:
    return np.array(data.split(), float).reshape(-1, 2)


_LOCATIONS = {".clocs": _clocs, ".locs": _locs, "_pos.txt": _pos}


def read_locations(spark: SparkSession, path: str, suffix: str, permissive: bool = False) -> DataFrame:
    """tile, cluster, x, y from files that end with suffix (.clocs, .locs or _pos.txt); another suffix is an error, no such file gives no rows.

    permissive: a bad file gives one row of nulls with what is wrong in the further column error.
    """
    if suffix not in _LOCATIONS:
        raise ValueError(f"no reader for locations in *{suffix}; there are {', '.join(_LOCATIONS)}")
    parse = _LOCATIONS[suffix]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for p, data in zip(d["path"], d["content"], strict=True):
                try:
                    xy = parse(data)
                except (ValueError, struct.error) as e:
                    if not permissive:
                        raise
                    yield pd.DataFrame({"path": [p], "cluster": pd.array([None], "Int32"), "x": [None], "y": [None], "error": [f"{p}: {e}"]})
                    continue
                yield pd.DataFrame({"path": p, "cluster": pd.array(np.arange(len(xy)), "Int32"), "x": xy[:, 0], "y": xy[:, 1], "error": None})

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select("path", "content")
    rows = files.mapInPandas(run, "path string, cluster int, x double, y double, error string")
    return rows.select(_stem(suffix.replace(".", r"\.")).alias("tile"), "cluster", "x", "y", *["error"] * permissive)


def locations_text(loc: DataFrame) -> DataFrame:
    return loc.select("tile", "cluster", F.format_string("%.2f %.2f", "x", "y").alias("value"))


def _locs_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, cluster, x, y) -> (name, cluster, data): each pair as two floats."""
    for batch in batches:
        xy = np.stack([np.asarray(batch.column(i), "<f4") for i in (2, 3)], axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in xy], pa.binary())], names=["name", "cluster", "data"])


@F.pandas_udf(BinaryType())
def _locs_head(n: pd.Series) -> pd.Series:
    return n.map(lambda k: struct.pack("<ifi", 1, 1.0, k))


def write_locs(loc: DataFrame, path: str) -> list[str]:
    """loc (tile, cluster, x, y) as one .locs file a tile, in order of clusters; the paths written. A file is one task's work, batch by batch."""
    name = F.concat("tile", F.lit(".locs")).alias("name")
    heads = loc.groupBy(name).agg(F.count("*").alias("n")).select("name", F.lit(-1).alias("cluster"), _locs_head("n").alias("data"))
    rows = loc.select(name, F.col("cluster").cast("int").alias("cluster"), "x", "y").mapInArrow(_locs_bytes, "name string, cluster int, data binary")
    return write_files(heads.unionByName(rows), path, "cluster")


def convert_locations(spark: SparkSession, path: str, to: str) -> list[str]:
    """Every .locs file of a folder as <base>_pos.txt in another; the paths written. A task holds a file."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for p, data in zip(d["path"], d["content"], strict=True):
                text = "".join(f"{x:.2f} {y:.2f}\n" for x, y in _locs(data))
                yield pd.DataFrame({"name": [p.rpartition("/")[2].removesuffix(".locs") + "_pos.txt"], "data": [text.encode()]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.locs").load(path).select("path", "content")
    return write_files(files.mapInPandas(run, "name string, data binary"), to)


def numbered_lines(spark: SparkSession, path: str, keep=None) -> DataFrame:
    """row, value: the lines of a text that keep (a column over value) takes, numbered from 0 in order of files and places, without a sort.

    Spark reads a file in splits, each in order, side by side. Lines are counted by split, the counts of the splits before are added
    up (a row for each split), and a line's number is that sum and its place in its split.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.where(keep) if keep is not None else lines
    lines = lines.withColumn("at", F.monotonically_increasing_id())  # runs on within a split
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "block", (before - F.col("first")).alias("shift"))
    return lines.join(F.broadcast(starts), ["file", "block"]).select((F.col("at") + F.col("shift")).alias("row"), "value")


def read_sam(spark: SparkSession, path: str, pairing: str = "name") -> DataFrame:
    """tile, cluster, flag, rname, cigar, md of aligned reads without gaps.

    pairing "name": the cluster comes from the read's name, Cluster_<tile>_<n>. "row": from the line's place among those that are
    neither header lines nor empty, whatever the names; tile is null then.
    """
    if pairing not in ("name", "row"):
        raise ValueError("pairing is by name or row")
    f = F.split("value", "\t")
    if pairing == "row":
        lines = numbered_lines(spark, path, ~F.col("value").startswith("@") & (F.col("value") != ""))
        cluster, tile = F.col("row").cast("int"), F.lit(None).cast("string")
    else:
        lines = spark.read.text(path).where(~F.col("value").startswith("@"))
        name = r"^Cluster_(.*)_(\d+)$"
        cluster, tile = F.regexp_extract(f[0], name, 2).try_cast("int") - 1, F.regexp_extract(f[0], name, 1)
    t = lines.where(F.size(f) > 10).select(tile.alias("tile"), cluster.alias("cluster"), f[1].try_cast("int").alias("flag"), f[2].alias("rname"), f[5].alias("cigar"), F.regexp_extract("value", r"\tMD:Z:(\S+)", 1).alias("md"))
    return t.where(~F.col("rname").startswith("*") & ~F.col("cigar").rlike("[DI]") & (F.col("md") != ""))


def model_text(weights: list[float]) -> str:
    return "#MD3DECFQ\n" + "".join(f"{w:6.4g}," for w in weights) + "\n"


def write_model(weights: list[float], path: str) -> str:
    """The path; the file is there whole or not at all."""
    folder, _, name = path.rpartition("/")
    piece = SparkSession.active().createDataFrame([(name, bytearray(model_text(weights).encode()))], "name string, data binary")
    return write_files(piece, folder or ("/" if path.startswith("/") else "."))[0]


def parse_model(text: str) -> list[float]:
    head, _, rest = text.partition("\n")
    if head.strip() != "#MD3DECFQ":
        raise ValueError("not a model file")
    return [float(x) for x in rest.replace("\n", "").split(",") if x.strip()]


def read_model(spark: SparkSession, path: str) -> list[float]:
    return parse_model("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # one short file


def write_fastq(rows: DataFrame, path: str) -> None:
    """rows (tile, cluster, record), in order of tile and cluster over the parts."""
    rows.repartitionByRange("tile", "cluster").sortWithinPartitions("tile", "cluster").select(F.expr("substring(record, 1, length(record) - 1)").alias("value")).write.text(path)


def write_fastq_files(rows: DataFrame, path: str, prefix: str = "", suffix: str = "") -> list[str]:
    """rows (tile, cluster, record) as one file a tile, in order of clusters; the paths written. A file is one task's work, batch by batch; write_fastq has no such bound."""
    name = F.concat(F.lit(prefix), "tile", F.lit(suffix + ".fastq"))
    return write_files(rows.select(name.alias("name"), "cluster", F.col("record").cast("binary").alias("data")), path, "cluster")
