"""The data sources: what is read, what reaches the files, and files that are there whole or not at all."""

import struct
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_kernels import frame, simulated

from basewright import cli
from basewright.operators import estimate, train
from basewright.operators.quality import synthetic_weights
from basewright.plans.modes import Options, run
from basewright.sources import files, formats, intensities


def values(cycles=5, clusters=23, seed=0):
    return np.random.default_rng(seed).integers(-3000, 3000, (cycles, 4, clusters))


@pytest.fixture
def folder(tmp_path):
    for k, name in enumerate(("s_1_1", "s_1_2", "s_2_1")):
        (tmp_path / f"{name}.cif").write_bytes(formats.cif_bytes(values(seed=k)))
    return tmp_path


def read_of(df):
    """(first cycle, end, first cluster, end) of each planned piece: what the plan will read."""
    return [(p.files[0][0], p.files[-1][0] + 1, p.at, p.at + p.n) for p in df]


def test_reads_ranges_and_layouts(spark, folder):
    d = formats.read_intensities(spark, str(folder), partitionClusters="7")
    assert d.rdd.getNumPartitions() == 12
    got = {(r.tile, r.cluster): np.array(r.signal) for r in d.collect()}
    assert len(got) == 69 and all((got[(t, c)] == values(seed=k)[:, :, c]).all() for k, t in enumerate(("s_1_1", "s_1_2", "s_2_1")) for c in range(23))
    long = formats.read_intensities(spark, f"{folder}/s_1_*", layout="cycles", clusters="20,2")
    rows = {(r.tile, r.cluster, r.cycle): r.v for r in long.collect()}
    assert set(rows) == {(t, c, n) for t in ("s_1_1", "s_1_2") for c in (20, 21) for n in range(1, 6)}
    assert all(v == values(seed=int(t[-1]) - 1)[n - 1, :, c].tolist() for (t, c, n), v in rows.items())


def test_ranges_beyond_the_file_take_the_rest(spark, folder):
    one = f"{folder}/s_1_1.cif"
    d = formats.read_intensities(spark, one, (3, 9), clusters="20,50").collect()
    assert sorted(r.cluster for r in d) == [20, 21, 22] and all(len(r.signal) == 3 for r in d)
    assert all(len(r.signal) == 3 for r in formats.read_cif(spark, one, (3, 9)).collect())
    with pytest.raises(Exception, match="begins at 7 of 5"):
        formats.read_intensities(spark, one, (7, 9)).collect()
    for wrong in ({"cycles": (0, 3)}, {"clusters": "-1,3"}, {"layout": "planes"}):
        with pytest.raises(Exception):  # noqa: B017
            formats.read_intensities(spark, one, **wrong).collect()


def test_filters_reach_the_files(spark, folder):
    d = formats.read_intensities(spark, str(folder), layout="cycles")
    some = d.where("tile LIKE 's_1%' AND tile IN ('s_1_2', 's_2_1') AND cycle >= 2 AND cycle < 4 AND cluster > 5 AND cluster = 9 AND v[0] IS NOT NULL")
    plan = some._jdf.queryExecution().executedPlan().toString()
    left = [x for x in plan.split("\n") if "Filter" in x and "BatchScan" not in x]  # what Spark itself still filters
    assert "BatchScan intensities" in plan and left and not any("cycle" in x or "cluster" in x for x in left), left
    rows = some.collect()
    assert sorted((r.tile, r.cluster, r.cycle) for r in rows) == [("s_1_2", 9, 2), ("s_1_2", 9, 3)]
    reader = intensities.IntensityReader({"path": str(folder), "layout": "cycles"})
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual
    kept = list(reader.pushFilters([EqualTo(("tile",), "s_2_1"), GreaterThan(("cycle",), 3), LessThanOrEqual(("cluster",), 4), EqualTo(("v",), 1)]))
    assert [f.attribute for f in kept] == [("v",)] and read_of(reader.partitions()) == [(3, 5, 0, 5)]


def test_file_over_two_gigabytes(spark, tmp_path):
    """A sparse file of 4.3 GB, of which pieces of some clusters and cycles are read."""
    clusters, cycles = 5_400_000, 101
    path = tmp_path / "big.cif"
    at = lambda cycle, channel, cluster: 13 + 2 * ((cycle * 4 + channel) * clusters + cluster)
    with path.open("wb") as f:
        f.write(b"CIF" + bytes([1, 2]) + struct.pack("<HHI", 1, cycles, clusters))
        for cycle, channel, cluster, v in ((0, 0, 0, 5), (100, 3, 5_399_999, -7), (99, 2, 5_399_998, 11)):
            f.seek(at(cycle, channel, cluster))
            f.write(struct.pack("<h", v))
    assert path.stat().st_size == 13 + 8 * clusters * cycles > 4 << 30
    d = formats.read_intensities(spark, str(path), (100, 101)).where(F.col("cluster") >= clusters - 3)
    rows = {r.cluster: r.signal for r in d.collect()}
    assert rows == {clusters - 3: [[0] * 4] * 2, clusters - 2: [[0, 0, 11, 0], [0] * 4], clusters - 1: [[0] * 4, [0, 0, 0, -7]]}
    reader = intensities.IntensityReader({"path": str(path)})
    pieces = reader.partitions()
    assert len(pieces) > 100 and sum(p.n for p in pieces) == clusters and max(p.n * 8 * cycles for p in pieces) <= 32 << 20


def test_folders_with_a_missing_cycle(spark, tmp_path):
    v = values(4)
    for c in (1, 2, 4):
        (tmp_path / f"C{c}.1").mkdir()
        (tmp_path / f"C{c}.1/t.cif").write_bytes(formats.cif_bytes(v[c - 1 : c], c))
    for d in (formats.read_intensities(spark, str(tmp_path), (2, 4), True, partitionClusters="10"), formats.read_cif_folders(spark, str(tmp_path), 2, 4)):
        got = {r.cluster: np.array(r.signal) for r in d.collect()}
        assert len(got) == 23 and all((got[c][0] == v[1, :, c]).all() and not got[c][1].any() and (got[c][2] == v[3, :, c]).all() for c in range(23))


def test_bad_files_are_rows(spark, folder):
    (folder / "no.cif").write_bytes(b"BAD" + bytes(40))
    (folder / "cut.cif").write_bytes(formats.cif_bytes(values())[:-9])
    (folder / "empty.cif").write_bytes(b"")
    with pytest.raises(Exception, match="no.cif: not a CIF file"):
        formats.read_intensities(spark, str(folder)).collect()
    rows = formats.read_intensities(spark, str(folder), mode="PERMISSIVE").collect()
    bad = {r.tile: r.error for r in rows if r.error}
    assert set(bad) == {"no", "cut", "empty"} and "bytes" in bad["cut"] and all(r.cluster is None and r.signal is None for r in rows if r.error)
    assert sum(r.error is None for r in rows) == 69


def test_one_bad_file_leaves_the_other_tiles_unchanged(spark, tmp_path, capsys):
    place, ok, out = tmp_path / "in", tmp_path / "ok", tmp_path / "out"
    for seed, tile in ((1, "a"), (2, "b")):
        _, x = simulated(60, 10, seed)
        formats.write_cif(frame(spark, x * 4000, tile), str(place))
    for tile in ("a", "b", "bad", "cut", "gone", "nowhere"):
        (place / f"{tile}_pos.txt").write_text("".join(f"{i * 7 % 100}.0 {i * 3 % 60}.0\n" for i in range(60)))
    (place / "b_pos.txt").write_text("1.0 x\n")
    (place / "bad.cif").write_bytes(b"no intensities")
    (place / "cut.cif").write_bytes((place / "a.cif").read_bytes()[:500])
    formats.write_model(synthetic_weights(), str(tmp_path / "m"))
    alone = ["call", "-qfL", "-i", str(place), "-m", f"{tmp_path}/m"]
    assert cli.main([*alone, "-o", str(ok), "a"]) == 0
    capsys.readouterr()
    assert cli.main([*alone, "-o", str(out)]) == 0
    told = capsys.readouterr().err
    assert [p.name for p in out.iterdir()] == ["a.fastq"] and (out / "a.fastq").read_bytes() == (ok / "a.fastq").read_bytes()
    for tile, why in (("b", "locations:"), ("bad", "read:"), ("cut", "read:"), ("gone", "no intensities"), ("nowhere", "no intensities")):
        assert any(x.startswith(f"tile {tile},") and why in x for x in told.split("\n")), (tile, told)
    assert cli.main([*alone, "-o", str(out), "bad"]) == 1


def test_outcomes_of_kernels(spark):
    """A tile that a kernel can't take is told of; the others are as they would be alone."""
    _, x = simulated(60, 10)
    good = frame(spark, x, "good")
    uneven = frame(spark, x[:20], "uneven").unionByName(frame(spark, x[:1, :7], "uneven").withColumn("cluster", F.lit(20)))
    loc = spark.createDataFrame([("good", i, float(i * 3 % 50), float(i * 7 % 40)) for i in range(60)], "tile string, cluster int, x double, y double")
    out = run(good.unionByName(uneven), loc, Options(quality=True, weights=synthetic_weights()), outcomes=True)
    alone = run(good, loc, Options(quality=True, weights=synthetic_weights()))
    state = {r.tile: (r.stage, r.error) for r in out["outcomes"].collect()}
    assert state["good"] == (None, None) and state["uneven"][0] == "call" and "lengths" in state["uneven"][1]
    assert sorted(out["reads"].collect()) == sorted(alone["reads"].collect())


def test_chunks_stream_in_one_job(spark):
    """The chain's chunks equal the kernel run chunk by chunk, from one scan and one shuffle, with no job before the action."""
    _, x = simulated(90, 12, 3)
    d = frame(spark, x, "t").unionByName(frame(spark, x[:40] * 1.1, "u")).repartition(5)
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    out = estimate.basecall(d, most=30)
    assert set(tracker.getJobIdsForGroup(None)) == before
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = {(r.tile, r.cluster): np.array(r.signal) for r in out.collect()}
    for tile, y in (("t", x), ("u", x[:40] * 1.1)):
        n, params = len(y), None
        k = -(-n // 30)
        cuts = [int(np.floor(n / k * b + 0.5)) for b in range(k + 1)]
        for c in range(k):
            work = estimate.Chunk(y[cuts[c] : cuts[c + 1]], params)
            z, params = work.run(estimate.schedule(c, 4, False)), work.params()
            assert all(np.abs(got[(tile, cuts[c] + i)] - z[i]).max() < 1e-12 for i in range(len(z)))
    assert len(got) == 130


def test_files_are_whole_or_absent(spark, tmp_path):
    rows = spark.createDataFrame([(f"d/{n}", i, f"{n}{i};".encode()) for n in "ab" for i in range(50)], "name string, at int, data binary").repartition(7)
    to = str(tmp_path / "o")
    assert files.write_files(rows, to, "at") == [f"{to}/d/a", f"{to}/d/b"]
    assert (tmp_path / "o/d/a").read_bytes() == b"".join(f"a{i};".encode() for i in range(50))
    assert [p.name for p in (tmp_path / "o").iterdir()] == ["d"]

    @F.udf("binary")
    def broken(at, data):
        if at == 40:
            raise ValueError("lost")
        return bytes(data)

    with pytest.raises(Exception, match="lost"):
        files.write_files(rows.withColumn("data", broken("at", "data")), to, "at")
    assert (tmp_path / "o/d/a").read_bytes().startswith(b"a0;a1;") and [p.name for p in (tmp_path / "o").iterdir()] == ["d"]
    for name in ("", "/x", "../x"):
        with pytest.raises(Exception, match="no name"):
            files.write_files(rows.withColumn("name", F.lit(name)), to, "at")
    assert files.write_files(rows.where("false"), to, "at") == []


def test_two_attempts_of_a_task(tmp_path):
    """What an attempt that dies halfway, or is beaten by another, has written stays out of the result."""
    batch = lambda *rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], names=["name", "data"])
    writer = files.FilesWriter({"path": str(tmp_path)})

    def dying():
        yield batch(("a", b"half"))
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.write(dying())
    beaten = writer.write(iter([batch(("a", b"other attempt"))]))
    won = writer.write(iter([batch(("a", b"wh"), ("a", b"ole")), batch(("b", b"x"))]))
    assert beaten.files and not (tmp_path / "a").exists()
    writer.commit([won, None])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"] and (tmp_path / "a").read_bytes() == b"whole"
    with pytest.raises(ValueError, match="stand apart"):
        writer.write(iter([batch(("a", b"1"), ("b", b"2"), ("a", b"3"))]))
    writer.abort([])
    again = files.FilesWriter({"path": str(tmp_path)})
    both = [again.write(iter([batch(("c", b"1"))])) for _ in range(2)]
    with pytest.raises(ValueError, match="several tasks"):
        again.commit(both)
    again.abort(both)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]


FIRST_ATTEMPT_DIES = """
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
from basewright.sources import files
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()

@F.udf("binary")
def dies_once(at, data):
    if at == 700 and TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("lost")
    return bytes(data)

rows = spark.range(1000).select(F.lit("f").alias("name"), F.col("id").alias("at"), F.concat(F.col("id").cast("string"), F.lit(";")).cast("binary").alias("data"))
rows = rows.repartition(2, "name").sortWithinPartitions("name", "at").withColumn("data", dies_once("at", "data")).select("name", "data")
files.registered(spark)
rows.write.format("files").mode("append").option("path", sys.argv[1]).save()
"""


def test_a_first_attempt_dies(tmp_path):
    done = subprocess.run([sys.executable, "-c", FIRST_ATTEMPT_DIES, str(tmp_path / "o")], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "lost" in done.stderr  # the first attempt did die
    assert [p.name for p in (tmp_path / "o").iterdir()] == ["f"] and (tmp_path / "o/f").read_text() == "".join(f"{i};" for i in range(1000))


def sam_line(name, flag=0, cigar="12M", rname="ref", md="12"):
    return f"{name}\t{flag}\t{rname}\t1\t9\t{cigar}\t*\t0\t0\t{'A' * 12}\t{'I' * 12}\tMD:Z:{md}"


def test_lines_are_numbered_across_splits(spark, tmp_path):
    """Many splits of one file and several files: numbers run on in order, header and empty lines left out."""
    lines = [("" if i % 50 == 7 else "@x" if i % 31 == 3 else f"line {i} " + "x" * (i % 90)) for i in range(4000)]
    (tmp_path / "a.txt").write_text("\n".join(lines[:3000]) + "\n")
    (tmp_path / "b.txt").write_text("\n".join(lines[3000:]))
    want = [x for x in lines if x and not x.startswith("@")]
    for size in ("10000", "100000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            d = formats.numbered_lines(spark, str(tmp_path), ~F.col("value").startswith("@") & (F.col("value") != ""))
            got = sorted((r.row, r.value) for r in d.collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == list(enumerate(want))


def test_pairing_by_row(spark, tmp_path):
    """Reads of any name pair by their order; rejected lines keep their number; what doesn't pair is counted."""
    rows = [sam_line("any name"), sam_line("q", rname="*"), sam_line("q", cigar="5M1D7M"), sam_line("Cluster_x_99", 16, md="5A6"), "", sam_line("r" * 30), sam_line("beyond"), sam_line("beyond 2")]
    (tmp_path / "a.sam").write_text("@HD\n@SQ\n" + "\n".join(rows) + "\n")
    al = formats.read_sam(spark, f"{tmp_path}/a.sam", "row")
    assert sorted((r.cluster, r.flag, r.md) for r in al.collect()) == [(0, 0, "12"), (3, 16, "5A6"), (4, 0, "12"), (5, 0, "12"), (6, 0, "12")]
    signals = frame(spark, np.abs(np.random.default_rng(0).normal(size=(5, 12, 4))))
    pairs = train.pairing(signals, al.withColumn("tile", F.lit("t"))).first()
    assert (pairs.clusters, pairs.aligned, pairs.paired, pairs.unpaired_clusters, pairs.unpaired_reads) == (5, 5, 3, 2, 2)
    assert train.labelled(signals, al.withColumn("tile", F.lit("t"))).count() == 36
    assert [r.cluster for r in formats.read_sam(spark, f"{tmp_path}/a.sam").where("cluster IS NOT NULL").collect()] == [98]


def test_sparse_sums_equal_dense():
    rng = np.random.default_rng(1)
    n, k = 200, 70
    x = np.zeros((n, k))
    lists = []
    for row in x:
        at = rng.choice(k, int(rng.integers(0, 9)), replace=False)
        row[at] = rng.normal(size=len(at))
        lists.append([{"i": int(i), "v": float(row[i])} for i in at])
    y, w = rng.integers(0, 2, n), rng.normal(size=k)
    column = pa.array(lists, pa.list_(pa.struct([("i", pa.int32()), ("v", pa.float64())])))
    loss, g, h = train.partial_sums(w, y.astype(float), *train.entries(column))
    sign = 2 * y - 1
    p = 1 / (1 + np.exp(sign * (x @ w)))
    assert abs(loss - np.log1p(np.exp(-sign * (x @ w))).sum()) < 1e-9
    assert np.abs(g + x.T @ (sign * p)).max() < 1e-9 and np.abs(h - x.T @ (x * (p * (1 - p))[:, None])).max() < 1e-9
