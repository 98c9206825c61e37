"""Tiles that arrive one after another."""

import json

from test_kernels import frame, simulated

from basewright.operators.quality import synthetic_weights
from basewright.plans.modes import Options
from basewright.sources import formats
from basewright.streaming.tiles import call_arriving


def test_each_tile_is_called_once(spark, tmp_path):
    """Tiles of three arrivals, the last after a restart; a bad file and one without locations are told of."""
    made, place, out, mark = tmp_path / "made", tmp_path / "in", tmp_path / "out", str(tmp_path / "mark")
    place.mkdir()
    for seed, tile in enumerate("abc"):
        formats.write_cif(frame(spark, simulated(60, 10, seed)[1] * 4000, tile), str(made))
    (made / "bad.cif").write_bytes(b"nothing")
    (made / "lost.cif").write_bytes((made / "a.cif").read_bytes())

    def arrive(*tiles):
        for tile in tiles:
            if tile != "lost":
                (place / f"{tile}_pos.txt").write_text("".join(f"{i * 7 % 100}.0 {i * 3 % 60}.0\n" for i in range(60)))
            (made / f"{tile}.cif").rename(place / f"{tile}.cif")

    def called(most=None):
        call_arriving(spark, str(place), str(out), mark, Options(quality=True, fast=True, weights=synthetic_weights()), most=most).awaitTermination()
        return {p.name: p.stat().st_mtime_ns for p in out.glob("*.fastq")}

    arrive("a", "bad")
    first = called()
    assert set(first) == {"a.fastq"}
    assert called() == first  # nothing new: nothing is called again
    arrive("b", "lost")
    second = called(1)
    assert set(second) == {"a.fastq", "b.fastq"} and second["a.fastq"] == first["a.fastq"]
    arrive("c")
    third = called()
    assert set(third) == {"a.fastq", "b.fastq", "c.fastq"} and all(third[n] == second[n] for n in second)
    told = [json.loads(x) for p in (out / "_outcomes").iterdir() for x in p.read_text().splitlines()]
    assert sorted((r["tile"], r["stage"]) for r in told) == sorted([("a", None), ("b", None), ("c", None), ("bad", "read"), ("lost", "locations")], key=lambda x: (x[0], x[1] or ""))
    assert [p.name for p in out.iterdir() if p.name.startswith("_pending")] == []
