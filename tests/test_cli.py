"""The command line from files to files."""

import numpy as np
import pytest
from test_kernels import frame, simulated

from basewright import cli
from basewright.operators.quality import synthetic_weights
from basewright.sources import formats


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two tiles with intensities, whole and by cycle, locations and a model."""
    to = tmp_path_factory.mktemp("run")
    for seed, tile in ((1, "s_1_01"), (2, "s_2_01")):
        _, x = simulated(80, 12, seed)
        s = frame(spark, x * 4000, tile)
        formats.write_cif(s, str(to))
        formats.write_cif(s, str(to / "cycles"), folders=True)
        for place in (to, to / "cycles"):
            (place / f"{tile}_pos.txt").write_text("".join(f"{i * 7 % 100}.0 {i * 3 % 60}.0\n" for i in range(80)))
    formats.write_model(synthetic_weights(), str(to / "m.model"))
    return to


def test_reads_of_selected_tiles(folder, tmp_path, capsys):
    assert cli.main(["call", "-qfL", "-i", str(folder), "-o", str(tmp_path), "-m", f'"{folder}/m.model"', "--oprefix", "p_", "--osubfix", "_q", "s_1+"]) == 0
    assert capsys.readouterr().out.split() == [f"{tmp_path}/p_s_1_01_q.fastq"]
    lines = (tmp_path / "p_s_1_01_q.fastq").read_text().split("\n")
    assert lines[0] == "@Cluster_s_1_01_1" and lines[4] == "@Cluster_s_1_01_2" and len(lines) == 321 and all(len(x) == 12 for x in lines[1:320:4])
    truth, _ = simulated(80, 12, 1)
    calls = np.array([["ACGT".index(c) for c in x] for x in lines[1:320:4]])
    assert (calls == truth).mean() > 0.9


def test_ends_and_folders(folder, tmp_path):
    assert cli.main(["call", "-tqzsSL", "-e", "2", "-c", "1,6,7,12", "-i", str(folder / "cycles"), "-o", str(tmp_path)]) == 0
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted([f"C{n}.1" for n in range(1, 13)] + [f"s_{t}_01_end{e}.fastq" for t in (1, 2) for e in (0, 1)])
    assert sorted(p.name for p in (tmp_path / "C7.1").iterdir()) == ["s_1_01.cif", "s_1_01_inner.cif", "s_2_01.cif", "s_2_01_inner.cif"]
    quals = (tmp_path / "s_1_01_end0.fastq").read_text().split("\n")[3::4]
    assert set("".join(quals)) == {chr(33 + 21)}


def test_again_recall_correct(folder, tmp_path, spark):
    assert cli.main(["call", "-rnL", "-i", str(folder), "-o", str(tmp_path), "-m", f"{folder}/m.model", "s_2_01"]) == 0
    assert cli.main(["recall", f"{folder}/s_1_01", f"{tmp_path}/x", "6", "-2", "-m", f"{folder}/m.model"]) == 0
    assert cli.main(["correct", f"{folder}/s_1_01", f"{tmp_path}/y"]) == 0
    assert sorted(p.name for p in tmp_path.iterdir()) == ["s_2_01.fastq", "x.fastq", "y.cif"]
    assert formats.read_cif(spark, str(tmp_path)).count() == 80


def test_train_and_locations(folder, tmp_path, spark):
    rows = [f"r{i}\t0\tref\t1\t9\t12M\t*\t0\t0\t{'A' * 12}\t{'I' * 12}\tMD:Z:{'5A6' if i % 3 else '12'}" for i in range(80)]
    (tmp_path / "a.sam").write_text("@HD\n" + "\n".join(r.replace(f"r{i}\t", f"Cluster_s_1_01_{i + 1}\t", 1) for i, r in enumerate(rows)) + "\n")
    assert cli.main(["train", f"{folder}/s_1_01", f"{tmp_path}/a", f"{tmp_path}/new.model"]) == 0
    assert len(formats.read_model(spark, str(tmp_path / "new.model"))) == 70
    formats.write_locs(spark.createDataFrame([("k", 0, 1.5, 2.0)], "tile string, cluster int, x double, y double"), str(tmp_path / "l"))
    assert cli.main(["locs2txt", str(tmp_path / "l"), str(tmp_path / "t")]) == 0 and (tmp_path / "t/k_pos.txt").read_text() == "1.50 2.00\n"


def test_wrong_use(folder, tmp_path, capsys):
    with pytest.raises(SystemExit):
        cli.main(["call", "-L"])
    with pytest.raises(SystemExit):
        cli.main(["call", "--nothing"])
    assert cli.main(["call", "-qL", "-i", str(folder), "-o", str(tmp_path)]) == 1 and "model" in capsys.readouterr().err
    assert cli.main(["call", "-tsL", "-i", str(folder), "-o", str(tmp_path)]) == 1
