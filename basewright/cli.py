"""Command line: calling, training, location conversion and the three small tools.

    python -m basewright.cli call -q -m MODEL [options] PATTERN...
    python -m basewright.cli train INTENSITIES ALIGNMENTS MODEL
    python -m basewright.cli locs2txt FROM TO
    python -m basewright.cli recall IN OUT BLOCK CLUSTERS -m MODEL
    python -m basewright.cli correct IN OUT

Single-letter switches may be joined (-qfs). Every end has its own pair in -c; --outpath and --oprefix are what they say.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright import __version__
from basewright.operators import estimate, train
from basewright.operators.quality import FEATURES, fastq, reads
from basewright.plans.modes import Options, run
from basewright.plans.tiles import matching
from basewright.sources import formats

_FULL = 4000.0


def _session(threads: int | None) -> SparkSession:
    builder = SparkSession.builder
    return (builder.master(f"local[{threads}]") if threads else builder).getOrCreate()


def _bare(text: str) -> str:
    """Without one pair of double quotes."""
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] == '"' else text


def _cycles(text: str | None, ends: int) -> list[tuple[int, int] | None]:
    """-c's first and last cycle of each end, from 1."""
    if text is None:
        return [None] * ends
    n = [int(x) for x in text.strip(",").split(",")]
    pairs = list(zip(n[::2], n[1::2], strict=True))
    if len(pairs) < ends or any(a < 1 or b < a for a, b in pairs):
        raise ValueError(f"-c needs a first and a last cycle for each of {ends} ends")
    return pairs[:ends]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="basewright", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    top.add_argument("--version", action="version", version=__version__)
    sub = top.add_subparsers(dest="program", required=True)
    call = sub.add_parser("call", help="intensities to reads or corrected intensities")
    for flag, text in (("t", "write corrected intensities"), ("q", "write reads"), ("r", "write reads, estimated anew after correction"), ("z", "write color- and phasing-corrected signals (_inner)"), ("n", "leave out the correction of neighbours"), ("f", "fast"), ("s", "a folder for each cycle in the input"), ("S", "and in the output"), ("L", "locations in _pos.txt")):
        call.add_argument(f"-{flag}", action="store_true", help=text)
    call.add_argument("-l", "--loctype", default=".clocs", type=_bare, help="suffix of location files")
    call.add_argument("-e", type=int, default=1, help="number of ends")
    call.add_argument("-c", help="first,last cycle of each end")
    call.add_argument("-i", "--inpath", default=".", type=_bare)
    call.add_argument("-o", "--outpath", default=".", type=_bare)
    call.add_argument("-m", type=_bare, help="score model")
    call.add_argument("-p", type=int, help="threads of a local session")
    for name in ("inprefix", "insubfix", "oprefix", "osubfix"):
        call.add_argument(f"--{name}", default="", type=_bare)
    call.add_argument("patterns", nargs="*", help="tile names, or beginnings before a +")
    one = sub.add_parser("train", help="a score model from intensities and alignments (.sam is added)")
    for name in ("intensities", "alignments", "model"):
        one.add_argument(name)
    one.add_argument("--pair", choices=("row", "name"), default="row", help="how alignments find their clusters")
    two = sub.add_parser("locs2txt", help="one .locs file or a folder of them to _pos.txt")
    for name in ("source", "to"):
        two.add_argument(name)
    three = sub.add_parser("recall", help="reads of one tile with blocks of so many cycles and chunks of so many clusters (below 0: so many chunks)")
    for name, kind in (("source", str), ("to", str), ("block", int), ("clusters", int)):
        three.add_argument(name, type=kind)
    three.add_argument("-m", required=True, type=_bare, help="score model")
    four = sub.add_parser("correct", help="one tile's intensities with neighbours taken out")
    for name in ("source", "to"):
        four.add_argument(name)
    return top


def tiles(spark: SparkSession, path: str, suffix: str, patterns: list[str]) -> list[str]:
    """The tiles that have a location file and match, in order of names: a name a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    stem = F.expr(f"substring(name, 1, length(name) - {len(suffix)})")
    return [r.tile for r in files.select(stem.alias("tile")).where(matching(F.col("tile"), patterns)).orderBy("tile").collect()]


def _intensities(spark: SparkSession, a: argparse.Namespace, cycles: tuple[int, int] | None) -> DataFrame:
    if a.s and cycles is None:
        raise ValueError("-s needs -c")
    rows = formats.read_intensities(spark, a.inpath, cycles, a.s, mode="PERMISSIVE")
    inner = F.expr(f"substring(tile, {len(a.inprefix) + 1}, length(tile) - {len(a.inprefix) + len(a.insubfix)})")
    return rows.where(F.col("tile").startswith(a.inprefix) & F.col("tile").endswith(a.insubfix)).withColumn("tile", inner)


def _reported(outcomes: DataFrame, names: list[str], end: int) -> None:
    """Every tile that has failed, and why, on stderr; an error if none has gone well."""
    seen = {r.tile: r for r in outcomes.collect()}  # a row a file
    bad = {t: f"{seen[t].stage}: {seen[t].error}" if t in seen else "read: no intensities" for t in names if t not in seen or seen[t].error is not None}
    for tile, why in sorted(bad.items()):
        print(f"tile {tile}, end {end} failed: {why}", file=sys.stderr)
    if names and len(bad) == len(names):
        raise ValueError("every tile has failed")


def call(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    suffix = "_pos.txt" if a.L else a.loctype
    weights = formats.read_model(spark, a.m) if a.m else []
    options = Options(tensor=a.t, quality=a.q or a.r, again=a.r, inner=a.z, spatial=not a.n, fast=a.f, weights=weights)
    names = tiles(spark, a.inpath, suffix, a.patterns)
    print(f"{len(names)} tiles: {' '.join(names)}", file=sys.stderr)
    loc = formats.read_locations(spark, a.inpath, suffix, permissive=True).where(F.col("tile").isin(names))
    written: list[str] = []
    for end, cycles in enumerate(_cycles(a.c, a.e)):
        signals = _intensities(spark, a, cycles).where(F.col("tile").isin(names)).withColumn("end_id", F.lit(end))
        out = run(signals.select("tile", "end_id", "cluster", "signal", "error"), loc, options, outcomes=True)
        first = cycles[0] - 1 if cycles else 0
        tag = f"_end{end}" if a.e > 1 else ""
        _reported(out["outcomes"], names, end)
        if "tensor" in out:
            written += formats.write_cif(out["tensor"], a.outpath, a.oprefix, a.osubfix + ("" if a.S else tag), first, a.S, scale=False)
        if "inner" in out:
            written += formats.write_cif(out["inner"], a.outpath, a.oprefix, a.osubfix + "_inner", first, a.S, scale=False)
        if "reads" in out:
            written += formats.write_fastq_files(out["reads"], a.outpath, a.oprefix, a.osubfix + tag)
    return written


def train_model(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """Alignments pair with clusters by their order, as the files are made; --pair name takes the numbers in the reads' names."""
    unit = F.transform("signal", lambda v: F.transform(v, lambda x: x / _FULL))
    signals = formats.read_intensities(spark, a.intensities if a.intensities.endswith(".cif") else a.intensities + ".cif").withColumn("signal", unit)
    aligned = formats.read_sam(spark, a.alignments + ".sam", a.pair)
    aligned = aligned.drop("tile").join(F.broadcast(signals.select("tile").distinct()))  # one tile
    pairs = train.pairing(signals, aligned).first()
    print(f"{pairs.paired} of {pairs.aligned} aligned reads pair with {pairs.clusters} clusters; {pairs.unpaired_reads} reads don't", file=sys.stderr)
    seen = train.diagnostics(signals, aligned).first()
    print(f"mean of s {seen.mean_s}, deviation {seen.sd_s}, mismatched bases {seen.mismatches}", file=sys.stderr)
    weights = train.train(train.features(train.labelled(signals, aligned)))
    return [formats.write_model(weights, a.model)]


def _one(spark: SparkSession, name: str) -> DataFrame:
    return formats.read_intensities(spark, name + ".cif").withColumn("end_id", F.lit(0))


def recall(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    z = estimate.basecall(_one(spark, a.source), most=a.clusters or None, block=a.block)
    folder, _, name = a.to.rpartition("/")
    rows = fastq(reads(z, ["tile", "end_id", "cluster"], formats.read_model(spark, a.m)).withColumn("tile", F.lit(name)))
    return formats.write_fastq_files(rows, folder or ".")


def correct(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    folder, _, tile = a.source.rpartition("/")
    loc = None
    for suffix in (".clocs", "_pos.txt"):
        found = formats.read_locations(spark, folder or ".", suffix).where(F.col("tile") == tile)
        if loc is None or loc.isEmpty():
            loc = found
    to, _, name = a.to.rpartition("/")
    out = run(_one(spark, a.source), loc, Options(tensor=True))["tensor"].withColumn("tile", F.lit(name))
    return formats.write_cif(out, to or ".", scale=False)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.program == "call" and not (a.t or a.q or a.r):
        parser().error("one of -t, -q and -r is needed")
    spark = _session(getattr(a, "p", None))
    try:
        if a.program == "locs2txt":
            written = formats.convert_locations(spark, a.source, a.to)
        else:
            written = {"call": call, "train": train_model, "recall": recall, "correct": correct}[a.program](spark, a)
    except (ValueError, FileNotFoundError, PySparkException) as e:
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    print("\n".join(written))
    return 0


if __name__ == "__main__":
    sys.exit(main())
