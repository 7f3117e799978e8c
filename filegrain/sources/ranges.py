"""Byte ranges of files as rows: planned by expressions, read by as many tasks as there is to read, and put together again.

A range is (path, s, e). Conditions on path, s and e drop ranges before anything is opened, since reading comes after them
in the plan. A large file is so read by many tasks, a lost executor's ranges are read again, and a task holds one range.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .partial import FileSource
from .plan import planned

RANGE_BYTES = 8 << 20
#: Bytes for a task.
TASK_BYTES = 128 << 20


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """path, size of files; their content isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))


def cut(files: DataFrame, range_bytes: int = RANGE_BYTES, wanted: Column | None = None) -> DataFrame:
    """path, size, s, e: the parts of files that are wanted (an array of (s, e); all of each file if not given), in pieces that end at multiples of range_bytes. Empty files have no ranges."""
    whole = F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("size").alias("e")))
    parts = files.withColumn("fg_part", F.explode(whole if wanted is None else wanted)).where("fg_part.e > fg_part.s")
    step = F.lit(range_bytes).cast("long")
    first, last = F.expr(f"fg_part.s div {range_bytes}"), F.expr(f"(fg_part.e - 1) div {range_bytes}")
    rows = parts.withColumn("fg_n", F.explode(F.sequence(first, last)))
    return rows.select("path", "size", F.greatest("fg_part.s", F.col("fg_n") * step).alias("s"), F.least("fg_part.e", (F.col("fg_n") + 1) * step).alias("e"))


def metadata_ranges(files: DataFrame, kind: str = "kind", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The ranges that hold metadata, by the table of sizes. files: path, size, kind; those whose boxes have to be walked first have none."""
    return cut(files, range_bytes, planned(kind, "size"))


def read(ranges: DataFrame, tasks: int | None = None) -> DataFrame:
    """path, s, e, bytes, error. Ranges are dealt out evenly, whatever file they are of: about TASK_BYTES for a task, if tasks isn't given."""

    def run(batches):
        source, path = None, None
        for batch in batches:
            for p, s, e in zip(*(batch.column(c).to_pylist() for c in ("path", "s", "e")), strict=True):
                data, error = None, None
                try:
                    if p != path:
                        source, path = FileSource(p), p
                    data = source.read(s, e)
                except OSError as x:
                    path, error = None, str(x)
                yield pa.record_batch([pa.array([p]), pa.array([s], pa.int64()), pa.array([e], pa.int64()), pa.array([data], pa.binary()), pa.array([error], pa.string())], ["path", "s", "e", "bytes", "error"])

    if tasks is None:
        total = ranges.agg(F.coalesce(F.sum(F.col("e") - F.col("s")), F.lit(0))).first()[0]
        tasks = max(1, math.ceil(total / TASK_BYTES))
    dealt = ranges.select("path", "s", "e").repartition(tasks, F.xxhash64("path", "s")).sortWithinPartitions("path", "s")
    return dealt.mapInArrow(run, "path string, s long, e long, bytes binary, error string")


def together(parts: DataFrame, key: str = "path") -> DataFrame:
    """key, content: a file's ranges one after the other (what lies between them is left out); null if one of them has an error."""
    said = parts.groupBy(key).agg(F.expr("listagg(bytes) WITHIN GROUP (ORDER BY s)").alias("content"), F.count_if(F.col("bytes").isNull()).alias("lost"))
    return said.select(key, F.when(F.col("lost") == 0, F.col("content")).alias("content"))
