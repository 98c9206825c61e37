"""Whole files from rows: df.write.format("files"), with rows (name, data) of one task joined to a file of each name.

Two phases: a task attempt writes below <path>/_pending-<job>/, in a folder of its own, and reports what it wrote; the job's commit
moves the files of the successful attempts, each whole, to their places and deletes the folder. What a lost executor, a failed or a
speculative attempt leaves behind is never seen under a final name, and a failed job leaves the old files as they were.

Options: path; manifest, a name: the commit then lists the files written in <path>/_manifest-<name>.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from basewright.sources import store


@dataclass
class Written(WriterCommitMessage):
    """(file written so far, name it gets, bytes) of one task."""

    files: list[tuple[str, str, int]]


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("files need a path")
        self.path, self.manifest = options["path"].rstrip("/"), options.get("manifest")
        self.pending = store.joined(self.path, f"_pending-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        folder = store.joined(self.pending, f"{task.partitionId()}-{task.taskAttemptId()}" if task else uuid.uuid4().hex)
        where, base = store.place_of(folder)
        done: list[tuple[str, str, int]] = []
        names: set[str] = set()
        out, now, size = None, None, 0

        def close() -> None:
            if out:
                out.close()
                done.append((store.joined(folder, str(len(done))), now, size))

        try:
            for batch in iterator:
                for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if name != now:
                        close()
                        if name in names or not name or name.startswith("/") or ".." in name.split("/"):
                            raise ValueError(f"rows of {name!r} stand apart" if name in names else f"{name!r} is no name of a file")
                        names.add(name)
                        where.create_dir(base, recursive=True)
                        out, now, size = where.open_output_stream(f"{base}/{len(done)}"), name, 0
                    out.write(data.as_buffer())
                    size += len(data.as_buffer())
            close()
        finally:
            with suppress(Exception):  # closed already, or broken
                if out:
                    out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name, _ in files]
        if len(set(names)) < len(names):
            raise ValueError(f"several tasks hold rows of {next(n for n in names if names.count(n) > 1)!r}")
        for temporary, name, _ in files:
            where, source = store.place_of(temporary)
            _, to = store.place_of(store.joined(self.path, name))
            where.create_dir(to.rpartition("/")[0] or ".", recursive=True)
            where.move(source, to)
        if self.manifest:
            where, to = store.place_of(store.joined(self.path, f"_manifest-{self.manifest}"))
            where.create_dir(to.rpartition("/")[0] or ".", recursive=True)
            with where.open_output_stream(to) as out:
                out.write(json.dumps(sorted(names)).encode())
        self._swept()

    def abort(self, messages: list[Written | None]) -> None:
        self._swept()

    def _swept(self) -> None:
        where, name = store.place_of(self.pending)
        with suppress(FileNotFoundError):
            where.delete_dir(name)


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "name string, data binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        if [f.name for f in schema] != ["name", "data"]:
            raise ValueError("files are written from columns name and data")
        return FilesWriter({k.lower(): v for k, v in self.options.items()})


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(FilesSource)
    return spark


def write_files(pieces: DataFrame, path: str, *order: str) -> list[str]:
    """pieces (name, data, order columns): each name's data joined in that order as one file below path. The paths written.

    A file is one task's work, which holds a batch of its pieces at a time.
    """
    spark = registered(pieces.sparkSession)
    manifest = uuid.uuid4().hex
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.repartition(n, "name").sortWithinPartitions("name", *order).select("name", "data")
    rows.write.format("files").mode("append").option("path", path).option("manifest", manifest).save()
    where, name = store.place_of(store.joined(path, f"_manifest-{manifest}"))
    with where.open_input_stream(name) as f:
        names = json.loads(f.read())
    where.delete_file(name)
    return [store.joined(path, n) for n in names]
