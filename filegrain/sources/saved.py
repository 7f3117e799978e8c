"""Rows saved as files: one file a row, by a data source that stages and commits, and one exact file that all tasks write together."""

from __future__ import annotations

import os
import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.layout import apart, placed

COMMITTED = "committed.txt"
BUFFER = 8 << 20


def _at(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    files: int


class FilesWriter(DataSourceArrowWriter):
    """Each attempt of a task writes into a folder of its own. The commit lists the folders of the attempts that count; nothing is seen before."""

    def __init__(self, stage: str):
        self.stage = stage

    def write(self, iterator) -> Staged:
        folder = f"{self.stage}/{uuid.uuid4().hex}"
        files, base = _at(folder)
        files.create_dir(base)
        n = 0
        for batch in iterator:
            for name, content in zip(batch.column("name"), batch.column("bytes"), strict=True):
                with files.open_output_stream(f"{base}/{name.as_py()}") as out:
                    out.write(content.as_buffer() or b"")
                n += 1
        return Staged(folder, n)

    def commit(self, messages) -> None:
        files, base = _at(self.stage)
        files.create_dir(base)
        with files.open_output_stream(f"{base}/{COMMITTED}.new") as out:
            out.write("".join(f"{m.folder}\n" for m in messages if m and m.files).encode())
        files.move(f"{base}/{COMMITTED}.new", f"{base}/{COMMITTED}")

    def abort(self, messages) -> None:
        from pyarrow.fs import FileType

        files, base = _at(self.stage)
        if files.get_file_info(base).type != FileType.NotFound:
            files.delete_dir(base)


class FilesSink(DataSource):
    """Writes name, bytes as files below the option stage; finish() brings them to their place."""

    @classmethod
    def name(cls) -> str:
        return "one_file_a_row"

    def writer(self, schema, overwrite):
        return FilesWriter(self.options["stage"])


def write_files(rows: DataFrame, path: str, name: str = "name", content: str = "bytes", order: list[str] | None = None) -> DataFrame:
    """Each row becomes a file below path. Returns rows' columns but content, with fg_name, the file's name.

    Names that clash are numbered apart in the given order (default: by content's hash); null contents make no file, empty ones an empty file; files
    that have such a name from an earlier run are replaced. A run that fails before its commit leaves nothing below path;
    one that fails after it is completed by finish(). Both path and the folder beside it, path.staged, have to be reached by all executors.
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    spark.dataSource.register(FilesSink)
    given = rows.where(F.col(content).isNotNull()).withColumn("fg_bytes", F.col(content).cast("binary"))
    named = apart(given, name, order or [F.xxhash64("fg_bytes")])
    stage = f"{path}.staged/{uuid.uuid4().hex}"
    named.select(F.col("fg_name").alias("name"), F.col("fg_bytes").alias("bytes")).write.format("one_file_a_row").option("stage", stage).mode("append").save()
    finish(spark, path)
    return named.drop("fg_bytes", content)


def read_files(names: DataFrame, path: str, name: str = "fg_name") -> DataFrame:
    """name, content of the files of these names below path, each once, as write_files has told them. No folder is listed, so the driver sees none of them; a file that isn't there is an error."""

    def run(batches):
        files, base = _at(path.rstrip("/"))
        for batch in batches:
            held, size = {}, 0
            for own in batch.column(0).to_pylist():
                with files.open_input_stream(f"{base}/{own}") as f:
                    held[own] = f.read()
                size += len(held[own])
                if size >= BUFFER:
                    yield pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.binary())], ["name", "content"])
                    held, size = {}, 0
            yield pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.binary())], ["name", "content"])

    dealt = names.select(name).repartition(names.sparkSession.sparkContext.defaultParallelism, name)  # a name costs a file
    return dealt.mapInArrow(run, "name string, content binary")


def finish(spark: SparkSession, path: str) -> int:
    """Move the files of committed runs below path, by tasks; the number moved. It may be repeated: a file that is there already stays."""
    from pyarrow.fs import FileSelector, FileType

    path = path.rstrip("/")
    files, base = _at(f"{path}.staged")
    runs = [i.path for i in files.get_file_info(FileSelector(base, allow_not_found=True)) if files.get_file_info(f"{i.path}/{COMMITTED}").type == FileType.File]
    at_path = _at(path)[1]
    files.create_dir(at_path)
    prefix = f"{path}.staged/"

    def listed(batches):
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                system, at = _at(folder)
                found = [i.path for i in system.get_file_info(FileSelector(at, allow_not_found=True))]
                yield pa.record_batch([pa.array(found, pa.string())], ["at"])

    def moved(batches):
        system, target = _at(path)
        for batch in batches:
            n = 0
            for at in batch.column(0).to_pylist():
                to = f"{target}/{at.rsplit('/', 1)[1]}"
                if system.get_file_info(at).type == FileType.NotFound and system.get_file_info(to).type != FileType.NotFound:
                    continue  # an attempt before this one moved it
                system.move(at, to)
                n += 1
            yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

    total = 0
    for run in runs:
        folders = spark.read.text(f"{prefix}{run.rsplit('/', 1)[1]}/{COMMITTED}").repartition(spark.sparkContext.defaultParallelism)
        names = folders.mapInArrow(listed, "at string").repartition(F.xxhash64("at"))
        total += names.mapInArrow(moved, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        files.delete_dir(run)
    if not [i for i in files.get_file_info(FileSelector(base, allow_not_found=True))] and files.get_file_info(base).type != FileType.NotFound:
        files.delete_dir(base)
    return total


def write_exact(lines: DataFrame, path: str, order: list, line: str = "line", sep: str = "\r\n") -> int:
    """One file of all lines (null: empty) in order, with sep between them and none at the end; its size in bytes.

    Each task writes its own byte ranges at places that follow from running sums of sizes, so no task sees all lines. A
    task that is repeated writes the same bytes again; the file gets its name when all are written. path has to be on a file
    system that all executors mount, since stores of objects can't write at a place.
    """
    found = re.fullmatch(r"(?:file:/*(?=/))?(/.*)", path)
    if not found:
        raise ValueError(f"{path} is not a path that executors mount")
    target, end = found[1], sep.encode()
    made = lines.withColumn("fg_line", F.coalesce(F.col(line), F.lit("")))
    rows = placed(made, order, F.octet_length("fg_line") + len(end)).select("fg_at", "fg_line")
    total = rows.agg(F.max(F.col("fg_at") + F.octet_length("fg_line"))).first()[0] or 0
    staged = f"{target}.staged-{uuid.uuid4().hex}"

    def run(batches):
        out = os.open(staged, os.O_WRONLY)
        held, start, size, written = [], 0, 0, 0

        def flush() -> int:
            data, at = memoryview(b"".join(held)), start
            while data:
                n = os.pwrite(out, data, at)
                data, at = data[n:], at + n
            return at - start

        try:
            for batch in batches:
                for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    data = text.encode()
                    data += end if at + len(data) < total else b""
                    if held and (start + size != at or size >= BUFFER):
                        written += flush()
                        held, size = [], 0
                    if not held:
                        start = at
                    held.append(data)
                    size += len(data)
            written += flush()
            os.fsync(out)
        finally:
            os.close(out)
        yield pa.record_batch([pa.array([written], pa.int64())], ["n"])

    with open(staged, "wb") as f:
        f.truncate(total)
    try:
        written = rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if written != total:
            raise OSError(f"{written} of {total} bytes written")
        os.replace(staged, target)
    finally:
        if os.path.exists(staged):
            os.remove(staged)
    return total
