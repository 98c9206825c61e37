"""What each mode computes, from raw signals and locations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewright.functions import expr as E
from basewright.operators.estimate import basecall
from basewright.operators.quality import FEATURES, fastq, reads
from basewright.operators.spatial import correct_acc
from basewright.operators.state import kept


@dataclass(frozen=True)
class Options:
    """tensor: corrected signals wanted; quality: reads wanted; again: estimate anew on corrected signals; inner: keep the deconvolved ones; spatial: correct neighbours."""

    tensor: bool = False
    quality: bool = False
    again: bool = False
    inner: bool = False
    spatial: bool = True
    fast: bool = False
    iterations: int = 4
    weights: list[float] = field(default_factory=list)

    def __post_init__(self):
        if not (self.tensor or self.quality or self.again):
            raise ValueError("one of tensor, quality and again is needed")
        if (self.again or self.quality and not self.tensor) and len(self.weights) != FEATURES:
            raise ValueError(f"qualities need a model of {FEATURES} weights")


def quantised(signals: DataFrame) -> DataFrame:
    """Signals as int16 values; those of a tile and end in unit scale times 4000."""
    flat = F.flatten("signal")
    big = F.aggregate(flat, F.lit(0), lambda a, x: a + (F.abs(x) > 10).cast("int"))
    unit = signals.groupBy("tile", "end_id").agg((F.sum(big) < 0.5 * F.sum(F.size(flat))).alias("unit"))
    scale = F.when(F.col("unit"), 4000.0).otherwise(1.0)
    return signals.join(F.broadcast(unit), ["tile", "end_id"]).select("tile", "end_id", "cluster", F.transform("signal", lambda v: F.transform(v, lambda x: E.quantise(x, scale))).alias("signal"))


def _without(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """rows of the (tile, end)s that aren't in bad, a row for each file at most."""
    return rows.join(F.broadcast(bad.select("tile", "end_id").distinct()), ["tile", "end_id"], "left_anti")


class _Outcomes:
    """What has become of each (tile, end): those that fail at a stage leave the run there, the others go on."""

    def __init__(self, on: bool):
        self.on, self.failed, self.seen = on, [], None

    def _fail(self, bad: DataFrame, stage: str) -> DataFrame:
        bad = kept(bad.groupBy("tile", "end_id").agg(F.min("error").alias("error")).withColumn("stage", F.when(F.col("error").startswith("ReadError"), "read").otherwise(stage)))
        self.failed.append(bad)
        return bad

    def passed(self, rows: DataFrame, stage: str) -> DataFrame:
        """rows (..., error) of a stage, kept, without those of (tile, end)s that have an error there."""
        rows = kept(rows)
        if not self.on:
            return rows
        if self.seen is None:
            self.seen = rows.groupBy("tile", "end_id").agg(F.count("cluster").alias("clusters"))
        return _without(rows.where("error IS NULL").drop("error"), self._fail(rows.where("error IS NOT NULL"), stage))

    def located(self, signals: DataFrame, loc: DataFrame) -> tuple[DataFrame, DataFrame]:
        """signals of tiles with locations, and the locations."""
        if not self.on:
            return signals, loc
        error = F.min("error") if "error" in loc.columns else F.lit(None).cast("string")
        tiles = loc.groupBy("tile").agg(error.alias("wrong"), F.lit(True).alias("found"))
        known = signals.select("tile", "end_id").distinct().join(tiles, "tile", "left")
        bad = self._fail(known.withColumn("error", F.when(F.col("found"), F.col("wrong")).otherwise("no locations")).where("error IS NOT NULL"), "locations")
        return _without(signals, bad), loc.where("error IS NULL").drop("error") if "error" in loc.columns else loc

    def table(self) -> DataFrame:
        """tile, end_id, clusters, stage, error: a row for each (tile, end); the last two are null where all went well."""
        bad = self.failed[0]
        for b in self.failed[1:]:
            bad = bad.unionByName(b)
        return kept(self.seen.join(F.broadcast(bad.groupBy("tile", "end_id").agg(F.min_by("stage", "error").alias("stage"), F.min("error").alias("error"))), ["tile", "end_id"], "left"))


def run(signals: DataFrame, loc: DataFrame, options: Options, outcomes: bool = False) -> dict[str, DataFrame]:
    """tensor, reads and inner, as far as they are asked for; inner holds the signals that the reads come from, before the correction of neighbours.

    outcomes: a (tile, end) with an error in the columns of that name of signals or loc, without locations, or that a kernel can't
    solve is left out instead of ending the job, and a further table outcomes tells what has become of each.
    """
    keys, out, state = ["tile", "end_id", "cluster"], {}, _Outcomes(outcomes)
    clean = state.passed(_called(signals, options, outcomes), "call")
    signals = signals.where("error IS NULL").drop("error") if "error" in signals.columns else signals
    if options.spatial or options.quality and options.tensor and not options.again:
        clean, loc = state.located(clean, loc)
    if outcomes:
        signals = signals.join(F.broadcast(clean.select("tile", "end_id").distinct()), ["tile", "end_id"], "left_semi")
    correct = lambda s, e: state.passed(correct_acc(s, e, loc, outcomes=outcomes), "correct")
    if options.again:
        raw = correct(signals, clean) if options.spatial else signals
        if options.tensor:
            out["tensor"] = quantised(raw)
        clean = state.passed(_called(raw, options, outcomes), "call")
        out["reads"] = fastq(reads(clean, keys, options.weights))
    elif options.quality:
        z = clean if not options.spatial and not options.tensor else correct(clean, clean)
        if options.tensor:
            out["tensor"] = quantised(z)
        out["reads"] = fastq(reads(z, keys, options.weights or [0.0] * FEATURES, constant=options.tensor))
    else:
        out["tensor"] = quantised(correct(signals, clean) if options.spatial else signals)
    if options.inner and "reads" in out:
        out["inner"] = quantised(clean)
    if outcomes:
        out["outcomes"] = state.table()
    return out


def _called(signals: DataFrame, options: Options, outcomes: bool) -> DataFrame:
    return basecall(signals, options.iterations, options.fast, outcomes=outcomes)
