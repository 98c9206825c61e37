"""New tiles as a stream: each intensity file that arrives in a folder is called once, also over restarts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basewright.plans.modes import Options, run
from basewright.sources import formats
from basewright.sources.files import write_files

#: What Spark's reader of whole files gives.
FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """A stream of tiles, by the names of the intensity files that arrive; most: so many in a batch at most. No content is read."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.cif")
    files = files.option("maxFilesPerTrigger", most) if most else files
    return files.load(path).select(F.regexp_extract("path", r"([^/]+)\.cif$", 1).alias("tile"))


def call_arriving(spark: SparkSession, path: str, to: str, checkpoint: str, options: Options, suffix: str = "_pos.txt", most: int | None = None, once: bool = True) -> StreamingQuery:
    """Call the tiles that arrive in a folder, each with its location file there, into FASTQ files, and tell what became of each in
    <to>/_outcomes/<batch>.jsonl.

    Spark's checkpoint tells which files were seen, so a tile belongs to one batch for good. A batch that fails halfway runs again
    with the same tiles, and its files replace themselves, whole: each tile's reads are there exactly once. once: what has
    arrived is called and the stream ends; it goes on from there when it is started again. A file must be moved into the folder when
    it is complete, after its locations; a tile without these is told of as failed, and isn't called later.
    """
    def batch(tiles: DataFrame, number: int) -> None:
        names = [r.tile for r in tiles.distinct().collect()]  # a name a file
        if not names:
            return
        session = tiles.sparkSession
        signals = formats.read_intensities(session, path, mode="PERMISSIVE").where(F.col("tile").isin(names)).withColumn("end_id", F.lit(0))
        loc = formats.read_locations(session, path, suffix, permissive=True).where(F.col("tile").isin(names))
        out = run(signals.select("tile", "end_id", "cluster", "signal", "error"), loc, options, outcomes=True)
        if "reads" in out:
            formats.write_fastq_files(out["reads"], to)
        if "tensor" in out:
            formats.write_cif(out["tensor"], to, scale=False)
        rows = [json.dumps(r.asDict()) for r in out["outcomes"].orderBy("tile").collect()]  # a row a file
        piece = session.createDataFrame([(f"_outcomes/{number}.jsonl", bytearray(("\n".join(rows) + "\n").encode()))], "name string, data binary")
        write_files(piece, to)

    stream = arriving(spark, path, most).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
