"""Kernels, formats and modes on simulated signals."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from basewright.functions import expr as E
from basewright.operators import blocks, estimate, spatial
from basewright.operators.quality import reads, scored_cycles, synthetic_weights
from basewright.operators.train import features, labelled, train
from basewright.plans.modes import Options, run
from basewright.sources import formats

MIX = np.array([[1.0, 0.4, 0.0, 0.0], [0.5, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.4], [0.0, 0.0, 0.3, 1.0]]).T


def simulated(n=600, cycles=20, seed=1):
    rng = np.random.default_rng(seed)
    truth = rng.integers(0, 4, (n, cycles))
    light = rng.uniform(0.8, 1.2, n)
    h = np.eye(4)[truth] * light[:, None, None]
    band = np.zeros((cycles, cycles))
    band[0, 0] = 1
    for t in range(1, cycles):
        band[t] = 0.997 * (0.006 * band[t - 1] + 0.99 * np.roll(band[t - 1], 1) + 0.004 * np.roll(band[t - 1], 2))
    x = np.einsum("ts,nsk->ntk", band, h) @ MIX.T + 0.05 + rng.normal(0, 0.02, (n, cycles, 4))
    return truth, x


def frame(spark, x, tile="t"):
    return spark.createDataFrame([(tile, 0, i, s.tolist()) for i, s in enumerate(x)], "tile string, end_id int, cluster int, signal array<array<double>>")


@pytest.mark.parametrize("fast", [False, True])
def test_deconvolution_recovers_calls(fast):
    truth, x = simulated()
    z = estimate.Chunk(x).run(estimate.schedule(0, 3 if fast else 4, fast), fast)
    assert (estimate.calls_of(z) == truth).mean() > 0.99


def test_basecall_in_chunks(spark):
    truth, x = simulated(300)
    out = estimate.basecall(frame(spark, x).repartition(3), most=150).orderBy("cluster").collect()
    calls = estimate.calls_of(np.array([r.signal for r in out]))
    assert len(out) == 300 and (calls == truth).mean() > 0.98


def test_block_plan():
    assert [b[2] for b in blocks.block_plan(101)] == [13] * 5 + [12] * 3
    assert [b[1:] for b in blocks.block_plan(16)] == [(0, 8, 0, 14), (8, 8, 2, 14)]
    assert [b[2] for b in blocks.block_plan(37)] == [13, 12, 12]


def test_spatial_correction(spark):
    rng = np.random.default_rng(2)
    n, cycles = 40, 12
    truth = rng.integers(0, 4, (n, cycles))
    clean = np.eye(4)[truth] * 1.0
    x = clean + rng.normal(0, 0.02, clean.shape)
    x[1] += 0.4 * clean[0]
    loc = spark.createDataFrame([("t", i, float(i * 40), float(i % 7)) if i > 1 else ("t", i, float(i * 2), 0.0) for i in range(n)], "tile string, cluster int, x double, y double")
    s = frame(spark, x)
    out = {r.cluster: np.array(r.signal) for r in spatial.correct_acc(s, s, loc).collect()}
    assert len(out) == n
    assert np.abs(out[1] - clean[1]).mean() < np.abs(x[1] - clean[1]).mean() / 2
    far = spark.createDataFrame([("t", i, float(i * 40), 0.0) for i in range(n)], "tile string, cluster int, x double, y double")
    same = {r.cluster: np.array(r.signal) for r in spatial.correct_acc(s, s, far).collect()}
    assert all(np.allclose(same[i], x[i]) for i in range(n))


@pytest.mark.parametrize("options,wanted", [(Options(quality=True, weights=synthetic_weights()), {"reads"}), (Options(tensor=True, quality=True, inner=True), {"reads", "tensor", "inner"}), (Options(again=True, tensor=True, weights=synthetic_weights()), {"reads", "tensor"}), (Options(tensor=True, spatial=False), {"tensor"})])
def test_modes(spark, options, wanted):
    _, x = simulated(60, 8)
    loc = spark.createDataFrame([("t", i, float(i * 3 % 50), float(i * 7 % 40)) for i in range(60)], "tile string, cluster int, x double, y double")
    out = run(frame(spark, x), loc, options)
    assert set(out) == wanted and all(d.count() == 60 for d in out.values())


def test_mode_is_needed():
    for wrong in ({}, {"quality": True}, {"again": True}, {"quality": True, "weights": [1.0]}):
        with pytest.raises(ValueError):
            Options(**wrong)
    Options(tensor=True, quality=True)


def test_cif(spark, tmp_path):
    v = np.arange(-12, 12).reshape(2, 4, 3)
    (tmp_path / "a.cif").write_bytes(formats.cif_bytes(v))
    got = {r.cluster: r.signal for r in formats.read_cif(spark, str(tmp_path)).collect()}
    assert got[1] == v[:, :, 1].tolist()
    assert len(formats.read_cif(spark, str(tmp_path), (2, 2)).first().signal) == 1
    assert len(formats.read_cif(spark, str(tmp_path), (2, 9)).first().signal) == 1  # a range beyond the file takes what remains from its first cycle on
    with pytest.raises(ValueError):
        formats.cif_header(b"BAD" + bytes(20))
    for c in (1, 3):
        (tmp_path / f"run/C{c}.1").mkdir(parents=True)
        (tmp_path / f"run/C{c}.1/t.cif").write_bytes(formats.cif_bytes(v[:1], c))
    rows = formats.read_cif_folders(spark, str(tmp_path / "run"), 1, 3).collect()
    assert len(rows) == 3 and all(r.signal[1] == [0.0] * 4 and r.signal[0] == r.signal[2] for r in rows)


def test_locations(spark, tmp_path):
    (tmp_path / "t.clocs").write_bytes(bytes(5) + bytes([1, 10, 20]) + bytes([0]) + bytes([2, 0, 0, 250, 5]) + bytes(80) + bytes([1, 10, 10]))
    got = [(r.x, r.y) for r in formats.read_locations(spark, str(tmp_path), ".clocs").orderBy("cluster").collect()]
    assert got[:3] == [(1.0, 2.0), (50.0, 0.0), (75.0, 0.5)] and got[3] == (26.0, 26.0)
    (tmp_path / "t.locs").write_bytes(struct.pack("<ifi4f", 1, 1.0, 2, 1.5, 2.5, 3, 4))
    assert [r.value for r in formats.locations_text(formats.read_locations(spark, str(tmp_path), ".locs")).collect()] == ["1.50 2.50", "3.00 4.00"]
    (tmp_path / "t_pos.txt").write_text("1 2\n3 4")
    assert formats.read_locations(spark, str(tmp_path), "_pos.txt").count() == 2


def test_model_and_md(spark):
    w = synthetic_weights()
    assert np.allclose(formats.parse_model(formats.model_text(w)), w)
    got = spark.createDataFrame([("10A5^AC3",), ("0C2",)], "md string").select(E.md_flags(F.col("md")).alias("f")).collect()
    assert got[0].f == [2] * 10 + [1] + [2] * 8 and got[1].f == [1, 2, 2]


def test_training_finds_the_gap(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, (300, 10, 4))
    gap = np.sort(x, axis=2)[:, :, 3] - np.sort(x, axis=2)[:, :, 2]
    good = rng.uniform(size=gap.shape) < 1 / (1 + np.exp(-12 * (gap - 0.2)))
    lines = [f"Cluster_t_{i + 1}\t0\tref\t1\t9\t10M\t*\t0\t0\t{'A' * 10}\t{'I' * 10}\tMD:Z:" + "".join("1" if m else "A" for m in g).replace("1", "M") for i, g in enumerate(good)]
    import re
    lines = [re.sub(r"M+", lambda m: str(len(m[0])), t.rpartition(":")[2]).join([t.rpartition(":")[0] + ":", ""]) for t in lines]
    (tmp_path / "a.sam").write_text("@HD\n" + "\n".join(lines) + "\n")
    al = formats.read_sam(spark, str(tmp_path / "a.sam"))
    assert al.count() == 300
    rows = labelled(frame(spark, x), al)
    w = train(features(rows))
    assert len(w) == 70 and w[4] + w[3] > w[0]


def test_writers_and_range_reader(spark, tmp_path):
    """What is written is read back: whole files, folders of cycles, ranges of clusters, with names, scale and clamps."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.4, (23, 5, 4))
    x[0, 0] = [9, -9, 0.00026, -0.0003]
    s = frame(spark, x, "s_1").unionByName(frame(spark, x * 4000, "s_2"))
    want = np.clip(np.trunc(np.minimum(x * 4000, 32767) + 0.5), -32768, 32767)
    names = formats.write_cif(s, str(tmp_path / "a"), "p_", "_q")
    assert [n.rpartition("/")[2] for n in names] == ["p_s_1_q.cif", "p_s_2_q.cif"]
    head = (tmp_path / "a/p_s_1_q.cif").read_bytes()[:13]
    assert head == b"CIF" + bytes([1, 2]) + struct.pack("<HHI", 1, 5, 23)
    for read in (lambda: formats.read_cif(spark, str(tmp_path / "a")), lambda: formats.read_cif_ranges(spark, str(tmp_path / "a"), 7)):
        got = {(r.tile, r.cluster): np.array(r.signal) for r in read().collect()}
        assert len(got) == 46 and all((got[(t, i)] == want[i]).all() for t in ("p_s_1_q", "p_s_2_q") for i in range(23))
    part = {r.cluster: np.array(r.signal) for r in formats.read_cif_ranges(spark, names[0], 10, (2, 4)).collect()}
    assert all((part[i] == want[i, 1:4]).all() for i in range(23)) and len(part) == 23
    assert len(formats.write_cif(s.where("tile = 's_1'"), str(tmp_path / "b"), first=10, folders=True)) == 5
    assert sorted(p.name for p in (tmp_path / "b").iterdir()) == [f"C{n}.1" for n in range(11, 16)]
    got = {r.cluster: np.array(r.signal) for r in formats.read_cif_folders(spark, str(tmp_path / "b"), 11, 15).collect()}
    assert all((got[i] == want[i]).all() for i in range(23))
    assert formats.output_name("t", "a", "b", 1) == "atb_end1" and formats.output_name("t", inner=True) == "t_inner"


def test_location_and_model_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("x", "y"):
        (tmp_path / f"in/{name}.locs").write_bytes(struct.pack("<ifi4f", 1, 1.0, 2, 1.504, 2.5, 3, 4))
    assert len(formats.convert_locations(spark, str(tmp_path / "in"), str(tmp_path / "out"))) == 2
    assert (tmp_path / "out/x_pos.txt").read_text() == "1.50 2.50\n3.00 4.00\n"
    with pytest.raises(ValueError):
        formats.read_locations(spark, str(tmp_path), ".xyz")
    assert formats.read_locations(spark, str(tmp_path / "out"), ".clocs").count() == 0
    formats.write_model(synthetic_weights(), str(tmp_path / "m.model"))
    assert formats.read_model(spark, str(tmp_path / "m.model")) == synthetic_weights()


def test_layout_expressions(spark):
    d = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]],)], "s array<array<double>>")
    s = F.col("s")
    r = d.select(E.rotated(s).alias("a"), E.assigned(s, 1, F.array(F.lit(0.0), F.lit(9.0))).alias("b"), E.multiplied(s, [[1, 1], [0, 2]]).alias("c"), E.gathered(s, F.array(F.lit(2), F.lit(0), F.lit(7))).alias("g"), E.picked(s, F.array(F.lit(True), F.lit(False), F.lit(True))).alias("p")).first()
    assert r.a == [[1, 3, 5], [2, 4, 6]] and r.b == [[1, 2], [0, 9], [5, 6]] and r.c == [[3, 4], [7, 8], [11, 12]] and r.g == [[5, 6], [1, 2], None] and r.p == [[1, 2], [5, 6]]


def test_centred_sample(spark):
    x = np.random.default_rng(6).uniform(0, 1, (40, 6, 4))
    al = spark.createDataFrame([("t", i, 0, "6") for i in range(40) if i % 5], "tile string, cluster int, flag int, md string")
    assert labelled(frame(spark, x), al).count() == 32 * 6
    few = labelled(frame(spark, x), al, most=60)
    clusters = sorted({r.cluster for r in few.collect()})
    known = [i for i in range(5, 40) if i % 5]
    assert clusters == known[:10] and few.count() == 60


def test_block_elimination_equals_dense():
    rng = np.random.default_rng(7)
    n = 300
    gx, gy = rng.integers(0, 40, n), rng.integers(0, 120, n)
    i, j = spatial.edges_of(gx, gy)
    coef = rng.uniform(0, 0.3, len(i))
    a = np.eye(n)
    np.add.at(a, (i, j), coef)
    z = rng.normal(size=(n, 5))
    got = spatial.block_solve(gy, i, j, coef, z, int(np.abs(gy[i] - gy[j]).max()))
    assert np.abs(a @ got - z).max() < 1e-8 and np.abs(got - np.linalg.solve(a, z)).max() < 1e-6


def test_sparse_solve_equals_dense():
    rng = np.random.default_rng(17)
    n = 400
    gx, gy = rng.integers(0, 40, n), rng.integers(0, 120, n)
    i, j = spatial.edges_of(gx, gy)
    coef = rng.uniform(0, 0.3, len(i))
    a = np.eye(n)
    np.add.at(a, (i, j), coef)
    z = np.hstack([rng.normal(size=(n, 7)), np.zeros((n, 1)), np.ones((n, 1))])
    x = spatial.sparse_solve(i, j, coef, z)
    assert np.abs(x - np.linalg.solve(a, z)).max() < 1e-6
    assert (spatial.sparse_solve(i[:0], j[:0], coef[:0], z) == z).all()
    alone = np.array([0, 1]), np.array([1, 0]), np.array([1.0, 1.0])  # singular: elimination is asked, and says so
    assert spatial.sparse_solve(*alone, np.array([[1.0], [0.0]])) is None


def test_stripe_of_100_000_clusters():
    """Memory of the solve stays near that of its edges and a few vectors, and the residuals are small."""
    import tracemalloc

    rng = np.random.default_rng(18)
    n = 100_000
    gx, gy = rng.integers(0, 280, n), rng.integers(0, 4000, n)
    i, j = spatial.edges_of(gx, gy)
    keep = rng.uniform(size=len(i)) < 0.3
    i, j = i[keep], j[keep]
    coef, z = rng.uniform(0, 0.3, len(i)), rng.normal(size=(n, 24))
    tracemalloc.start()
    x = spatial.solved_system(gy, i, j, coef, z)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.abs(z - spatial.Edges(n, i, j, coef).times(x)).max() < 1e-6
    assert len(i) > 100_000 and peak < z.nbytes * 2 + 60 * len(i) + 16 * 8 * spatial.VALUES_AT_ONCE


def test_pixel_map_and_edges():
    rng = np.random.default_rng(8)
    gx, gy = rng.integers(0, 12, 80), rng.integers(0, 12, 80)
    cells, row = {}, []
    for k in range(80):
        y = int(gy[k])
        while (int(gx[k]), y) in cells:
            y += 1
        cells[(int(gx[k]), y)] = k
        row.append(y)
    assert spatial.occupied(gx, gy).tolist() == row
    want = {(k, cells[(x, y)]) for k in range(80) for x in range(gx[k] - 4, gx[k] + 5) for y in range(gy[k] - 4, gy[k] + 5) if cells.get((x, y), k) != k}
    got = list(zip(*(v.tolist() for v in spatial.edges_of(gx, gy)), strict=True))
    assert len(got) == len(set(got)) and set(got) == want


def test_threshold_by_hand(spark):
    """Two clusters, two cycles: widths from the second-least magnitudes, mean largest 1.5."""
    x = np.array([[[1, 0.5, 0.2, 0.0], [2, 0.5, 0.1, 0.0]], [[1, 0.5, 0.4, 0.1], [2, 0.5, 0.1, 0.0]]])
    t = spatial.threshold(spatial.cycle_width(frame(spark, x), ["tile"]), ["tile"]).first()
    second = [[sorted(abs(v))[1] for v in c] for c in x]
    widths = [2 / (second[0][t] + second[1][t]) for t in range(2)]
    assert abs(t.thr - 0.3 * sum(widths) * 1.5) < 1e-12 and [round(v.width, 9) for v in t.w] == [round(w, 9) for w in widths]


def test_chunks_by_tile(spark):
    """A tile's chunks depend on its own size; boundaries as by the rounding rule."""
    rows = [(t, 0, i, [[0.0] * 4]) for t, n in (("a", 50), ("b", 7)) for i in range(n)]
    d = spark.createDataFrame(rows, "tile string, end_id int, cluster int, signal array<array<double>>")
    got = {(r.tile, r.cluster): r.chunk for r in estimate.in_chunks(d, 12).collect()}
    for t, n in (("a", 50), ("b", 7)):
        k = -(-n // 12)
        bounds = [int(np.floor(n / k * b + 0.5)) for b in range(1, k)]
        assert all(got[(t, i)] == sum(i >= b for b in bounds) for i in range(n))


def test_schedules():
    r = estimate.schedule(0, 4, False)
    assert [x.extra for x in r] == [6, 3, 2, 1, 0] and [x.wl for x in r] == [30, 40, 50, 60, 70] and [round(x.stein, 6) for x in r] == [0.05, 0.0338, 0.0176, round(0.0176 / 1.5, 6), round(0.0176 / 2.25, 6)]
    assert [len(estimate.schedule(k, 3, True)) for k in range(9)] == [4, 2, 0, 0, 1, 0, 0, 0, 1] and [len(estimate.schedule(k, 4, False)) for k in range(6)] == [5, 2, 2, 2, 1, 1]
    assert [len(estimate.schedule(k, 4, False, True)) for k in range(3)] == [4, 1, 1]


def test_serial_schedule_and_reuse():
    truth, x = simulated()
    work = estimate.Chunk(x)
    assert (estimate.calls_of(work.run_serial(estimate.schedule(0, 4, False, True))) == truth).mean() > 0.99
    again = estimate.Chunk(x, work.params())
    assert (estimate.calls_of(again.run([], True)) == truth).mean() > 0.99 and all((a == b).all() for a, b in zip(again.params().color, work.params().color, strict=True))


def test_neighbour_ratios_by_hand():
    z = np.array([[[1, 0, 0, 0], [2, 0, 0, 0]], [[1, 0, 0, 0], [4, 0, 0, 0]], [[0, 1, 0, 0], [0, 3, 0, 0]]], float)
    f = estimate.neighbour_ratios(z, estimate.calls_of(z), np.array([[0.5, 1.5, 1.0]]))
    assert abs(f[0, 0] - (0.1 + 0.9 * (3 + 6) / (1 + 2))) < 1e-12 and abs(f[1, 1] - (0.1 + 0.9 * (3 + 3) / 2)) < 1e-12 and abs(f[2, 3] - 2.8) < 1e-12


def test_sparse_logistic_equals_proximal_gradient(spark):
    """Spark's fit against a plain proximal gradient descent of the same objective."""
    rng = np.random.default_rng(9)
    n, c = 400, 0.2
    x = np.zeros((n, 70))
    for row in x:
        row[rng.choice(69, 6, replace=False)] = rng.normal(size=6)
    x[:, 69] = 1
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-(x[:, :10].sum(axis=1) * 2 + 1)))).astype(int)
    rows = spark.createDataFrame([(int(b), [(int(i), float(a[i])) for i in np.flatnonzero(a)]) for a, b in zip(x, y, strict=True)], "label int, x array<struct<i:int,v:double>>")
    got, w = np.array(train(rows, c)), np.zeros(70)
    sign, step = 2 * y - 1, 1 / (c * np.linalg.norm(x, 2) ** 2 / 4)
    for _ in range(20_000):
        w = w + step * c * x.T @ (sign / (1 + np.exp(sign * (x @ w))))
        w = np.sign(w) * np.maximum(np.abs(w) - step, 0)
    assert np.abs(got - w).max() < 1e-3 and np.abs(w).max() > 0.1


def test_fits_equal_augmented_least_squares():
    """Both fits against numpy's least squares with the pull toward the old parameters as further rows."""
    _, x = simulated(300, 16)
    work = estimate.Chunk(x)
    work.solve(range(2), -1, 30.0, lambda b: True)
    for b in range(2):
        w, n, p, c = work.w[b][:, None], np.arange(300), work.phase[b], work.color[b]
        h = work.source(b) @ c[:, :4].T
        a = np.hstack([h[n, :, n % 4], work.previous[b][n, n % 4][:, None], np.full((300, 1), work.scale)]) * w
        y = (work.own(b)[n, :, n % 4] - c[n % 4, 4][:, None]) * w
        pull = np.sqrt(0.05 * work.scale**2 * (w**2).sum()) * np.eye(a.shape[1])
        hold = pull.copy()
        hold[-1, -1] *= np.sqrt(3)
        # the extra hold on the last term pulls it toward a third of its old value's weight
        want = np.linalg.solve(a.T @ a + hold @ hold, a.T @ y + pull @ pull @ p.T).T
        assert np.abs(work.fit_phase(b, 0.05, 2) - want).max() < 1e-8
        plain = np.linalg.lstsq(np.vstack([a, pull]), np.vstack([y, pull @ p.T]), rcond=None)[0].T
        assert np.abs(work.fit_phase(b, 0.05, 0) - plain).max() < 1e-8
        t = n % work.plan[b][2]
        g = np.hstack([np.einsum("ns,nsk->nk", p[t, :-2], work.source(b)), np.ones((300, 1))]) * w
        y = (work.own(b)[n, t] - work.previous[b] * p[t, -2][:, None] - p[t, -1][:, None] * work.scale) * w
        pull = np.sqrt(0.05 * (w**2).sum()) * np.eye(5)
        plain = np.linalg.lstsq(np.vstack([g, pull]), np.vstack([y, pull @ c.T]), rcond=None)[0].T
        plain[:, :4] *= 2 * work.scale / np.linalg.norm(np.diag(plain[:, :4]))
        assert np.abs(work.fit_color(b, 0.05, 0) - plain).max() < 1e-8


def test_stripes_equal_one_dense_system(spark):
    """All of correct_acc on a tile of two stripes against edge-by-edge search and one dense solve of each stripe."""
    rng = np.random.default_rng(10)
    n, cycles = 120, 6
    x = np.abs(np.eye(4)[rng.integers(0, 4, (n, cycles))] + rng.normal(0, 0.1, (n, cycles, 4)))
    xy = np.stack([rng.integers(0, 400, n), rng.integers(0, 20, n)], axis=1).astype(float)
    loc = spark.createDataFrame([("t", i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "tile string, cluster int, x double, y double")
    s = frame(spark, x)
    out = {r.cluster: np.array(r.signal) for r in spatial.correct_acc(s, s, loc).collect()}
    gx, gy = (xy - xy.min(axis=0)).astype(int).T
    mags = np.sort(np.abs(x), axis=2)
    qd = (mags[:, :, 3] - mags[:, :, 2]).min(axis=1) / mags[:, :, 3].max(axis=1)
    width = n / mags[:, :, 1].sum(axis=0)
    thr = 0.3 * width.sum() * mags[:, :, 3].mean()
    value = lambda v: sum(w * (np.abs(c).sum() - abs(c.max())) for w, c in zip(width, v, strict=True))

    def share(a, b):
        lo, hi = 0.0, 0.98
        while hi - lo > 0.001:
            m = 0.618 * lo + 0.382 * hi
            lo, hi = (m, hi) if value(x[a] - m * x[b]) - value(x[a] - (m + 0.001) * x[b]) > thr * 0.001 else (lo, m)
        return lo

    stripes, done = -(-(gx.max() + 1) // 250), 0
    for k in range(stripes):
        low, high = 250 * k - 15, (250 * k + 235 if k < stripes - 1 else 10**9)
        ids = [i for i in range(n) if low - 15 <= gx[i] < high + 15]
        row = spatial.occupied(gx[ids], gy[ids])
        a = np.eye(len(ids))
        for p, i in enumerate(ids):
            for q, j in enumerate(ids):
                if i != j and qd[i] < 0.7 and abs(gx[i] - gx[j]) <= 4 and abs(gy[i] - row[q]) <= 4:
                    a[p, q] += share(i, j)
        z = np.linalg.solve(a, x[ids].reshape(len(ids), -1)).reshape(len(ids), cycles, 4)
        for p, i in enumerate(ids):
            if low <= gx[i] < high:
                done += 1
                assert np.abs(out[i] - z[p]).max() < 1e-6
    assert done == n == len(out)


def test_bucketed_tables_are_exchanged_by_stripe_alone(spark):
    """The same signals as without tables, whether evidence is the signals themselves or another table."""
    from basewright.operators.state import dropped

    rng = np.random.default_rng(20)
    x = np.abs(np.eye(4)[rng.integers(0, 4, (90, 5))] + rng.normal(0, 0.1, (90, 5, 4)))
    xy = np.stack([rng.integers(0, 400, 90), rng.integers(0, 20, 90)], axis=1).astype(float)
    loc = spark.createDataFrame([(t, i, float(a), float(b)) for t in "tu" for i, (a, b) in enumerate(xy)], "tile string, cluster int, x double, y double")
    s = frame(spark, x, "t").unionByName(frame(spark, x[:60] * 1.2, "u"))
    e = s.withColumn("signal", F.transform("signal", lambda v: F.transform(v, lambda a: a * 0.9)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for evidence in (s, e):
            out = spatial.correct_acc(s, evidence, loc, buckets=4)
            plan = out._jdf.queryExecution().executedPlan().toString()
            dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
            assert not any("cluster#" in line.split("hashpartitioning")[1].split(")")[0] for line in dealt), plan
            got = {(r.tile, r.cluster): np.array(r.signal) for r in out.collect()}
            want = {(r.tile, r.cluster): np.array(r.signal) for r in spatial.correct_acc(s, evidence, loc).collect()}
            assert set(got) == set(want) and len(got) == 150 and all(np.abs(got[k] - want[k]).max() < 1e-9 for k in got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert dropped(spark) == 5 and dropped(spark) == 0


def test_scores_of_odd_reads(spark):
    """Reads without cycles and null signals give no cycle rows, and cost the others no second pass over the signal."""
    rows = [(0, [[0.9, 0.1, 0.2, 0.0], [0.0, 0.3, 0.8, 0.1]]), (1, []), (2, None), (3, [[0.5, 0.5, 0.0, 0.0]])]
    signals = spark.createDataFrame(rows, "cluster int, signal array<array<double>>")
    scored = scored_cycles(signals, ["cluster"])
    got = {(r.cluster, r.cycle): (r.call, r.second, r["rank"], r.prev, round(r.gap, 9)) for r in scored.collect()}
    assert got == {(0, 0): (0, 2, 1, None, 0.7), (0, 1): (2, 1, 1, 0, 0.5), (3, 0): (0, 1, 0, None, 0.0)}
    assert "Filter (size(" not in scored._jdf.queryExecution().executedPlan().toString()
    made = {r.cluster: (r.seq, r.qual) for r in reads(signals, ["cluster"], synthetic_weights()).collect()}
    assert made[0][0] == "AG" and len(made[0][1]) == 2 and made[1] == ("", "") and made[2] == (None, None)


def test_pixels_within_and_cells_hold_every_pair(spark):
    rng = np.random.default_rng(4)
    gx, gy = rng.integers(0, 40, 300), rng.integers(0, 25, 300)
    want = {(a, b) for a in range(300) for b in range(300) if a != b and abs(gx[a] - gx[b]) <= 4 and abs(gy[a] - gy[b]) <= 4}
    got = list(zip(*(k.tolist() for k in spatial.pixels_within(gx, gy)), strict=True))
    assert len(got) == len(want) and set(got) == want
    points = spark.createDataFrame([("t", k, int(gx[k]), int(gy[k])) for k in range(300)], "tile string, cluster int, gx int, gy int")
    cells = {}
    for r in spatial.in_cells(points).collect():
        cells.setdefault((r.cx, r.cy), []).append(r)
    found = []
    for rows in cells.values():
        i, j = spatial.pixels_within(*(np.array([r[c] for r in rows]) for c in ("gx", "gy")), of=np.flatnonzero([r.own for r in rows]))
        found += [(rows[a].cluster, rows[b].cluster) for a, b in zip(i, j, strict=True)]
    assert len(found) == len(want) and set(found) == want


def test_solve_takes_the_cheaper_axis(monkeypatch):
    """A narrow grid with many clusters a pixel: rows of neighbours lie far apart, columns never more than the reach."""
    rng = np.random.default_rng(6)
    gx, gy = rng.integers(0, 120, 1500).astype(np.int32), rng.integers(0, 5, 1500).astype(np.int32)
    i, j = spatial.edges_of(gx, gy)
    coef, z = np.full(len(i), 0.3), rng.normal(size=(1500, 3))
    a = np.eye(1500)
    a[i, j] += coef
    heights, solve = [], spatial.block_solve
    monkeypatch.setattr(spatial, "block_solve", lambda *v: heights.append((v[0] is gx, v[5])) or solve(*v))
    x = spatial.solved_system(gy, i, j, coef, z, gx)
    assert heights == [(True, spatial.REACH)] and np.abs(x - np.linalg.solve(a, z)).max() < 1e-7


def test_a_full_column_is_walked_through_once():
    """20,000 clusters of one pixel: their rows in a time in proportion to them, not to their square."""
    import time

    gx, gy = np.zeros(20_000, np.int32), np.full(20_000, 3, np.int32)
    start = time.process_time()
    assert (spatial.occupied(gx, gy) == 3 + np.arange(20_000)).all() and time.process_time() - start < 1


def piled(spark):
    """Signals, other evidence and places: columns of the pixel map hold several times their rows, one more than LAYER rows."""
    rng = np.random.default_rng(23)
    n, deep, cycles = 900, spatial.LAYER + 600, 3
    s = spark.createDataFrame([], "tile string, end_id int, cluster int, signal array<array<double>>")
    places = []
    for tile, some in (("t", n), ("u", deep)):
        x = np.abs(np.eye(4)[rng.integers(0, 4, (some, cycles))] + rng.normal(0, 0.15, (some, cycles, 4)))
        x[:: 7, :, :] = np.eye(4)[0]  # too clear to be corrected
        xy = np.stack([rng.integers(0, 60, some), rng.integers(0, 4, some)], axis=1) if tile == "t" else np.stack([np.where(np.arange(some) < 20, np.arange(some) * 2, 7), np.arange(some) % 2], axis=1)
        places += [(tile, k, float(a), float(b)) for k, (a, b) in enumerate(xy.tolist())]
        s = s.unionByName(frame(spark, x, tile))
    e = s.withColumn("signal", F.transform("signal", lambda v: F.transform(v, lambda a: a * (1 + F.col("cluster") % 3 / 10)))).where("cluster % 11 <> 5")
    return s, e, spark.createDataFrame(places, "tile string, cluster int, x double, y double")


@pytest.mark.parametrize("own,buckets", [(True, None), (False, None), (False, 4)])
def test_piled_clusters_equal_their_whole_stripes(spark, own, buckets):
    """Clusters that none reaches are left out of the stripes, which so hold no more than the map has pixels, and come out as from the whole system."""
    from basewright.operators.state import dropped

    s, e, loc = piled(spark)
    e = s if own else e
    rows, limits = (d.toPandas() for d in spatial.placed_rows(s, e, loc, size=20, halo=5))
    want = {}
    for (tile, stripe), d in rows.groupby(["tile", "stripe"]):
        limit = limits[(limits.tile == tile) & (limits.stripe == stripe)].iloc[0]
        z = lambda c: spatial.signals_of(np.array([[list(v) for v in x] for x in c]))
        d = d.sort_values("cluster")
        p = spatial.pa.table({c: spatial.pa.array(d[c].to_numpy()) for c in ("cluster", "gx", "gy", "qd", "in_core")} | {c: z(d[c]) for c in ("signal", "evidence") if c in d})
        want |= {(tile, k): x for k, x in zip(*spatial.stripe_solved(p, np.array(limit.w), limit.thr), strict=True)}
    try:
        got = {(r.tile, r.cluster): np.array(r.signal) for r in spatial.correct_acc(s, e, loc, size=20, halo=5, buckets=buckets).collect()}
        assert set(got) == set(want) and len(got) == e.count()
        assert max(np.abs(got[k] - want[k]).max() for k in want) < 1e-7 * max(np.abs(x).max() for x in want.values())
        assert max(np.abs(want[r.tile, r.cluster] - np.array(r.signal)).max() for r in s.where("cluster % 11 <> 5").collect()) > 0.1
        held = spatial.placed_rows(s, e, loc, size=20, halo=5, layered=True)[0]
        assert held.where("layer IS NULL").groupBy("tile", "stripe").count().agg(F.max("count")).first()[0] <= 30 * (4 + spatial.REACH)
        assert held.agg(F.max("layer")).first()[0] == 1
    finally:
        dropped(spark)


def test_piled_clusters_of_a_failed_stripe(spark):
    """A tile with a value that isn't a number is told of, whether others reach its cluster or not; the other tile is whole."""
    s, _, loc = piled(spark)
    for cluster in (0, 899):  # 899 lies above the reach of others
        odd = s.where("tile = 't'").withColumn("signal", F.when(F.col("cluster") == cluster, F.transform("signal", lambda v: F.transform(v, lambda a: F.lit(float("nan"))))).otherwise(F.col("signal")))
        both = odd.unionByName(s.where("tile = 'u'"))
        out = spatial.correct_acc(both, both, loc, size=20, halo=5, outcomes=True).toPandas()
        assert set(out[out.error.notna()].tile) == {"t"} and (out.tile == "u").sum() == spatial.LAYER + 600
        with pytest.raises(Exception, match="no stable solution"):
            spatial.correct_acc(both, both, loc, size=20, halo=5).collect()
