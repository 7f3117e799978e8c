"""The folder that the driver and all executors reach, for what jobs write on their way."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local master, whose one process has one disk, may go without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors reach")
    import tempfile

    return tempfile.mkdtemp(prefix="filegrain-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is written there goes when the application ends, or by removed()."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, at = _files(spark, path)
    files.deleteOnExit(at)
    return path


def folder(spark: SparkSession, path: str) -> tuple[str, str]:
    """Make a folder; the scheme of its file system, and its path without it."""
    files, at = _files(spark, path)
    files.mkdirs(at)
    return files.getUri().getScheme(), at.toUri().getPath()


def removed(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder; an own one is set only where the session names none."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
