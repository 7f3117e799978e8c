"""Local and remote files: small ones through Spark's binaryFile reader, large ones in the ranges that hold metadata."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import native
from .partial import PARTIAL, FileSource, load_source
from .plan import FULL_LIMIT, HARD_LIMIT

READ = f"content binary, partial {PARTIAL}, error string"


def read_files(spark: SparkSession, path: str | list[str], pattern: str | None = None, most: int | None = None, full_limit: int = FULL_LIMIT, max_full: int = HARD_LIMIT) -> DataFrame:
    """file_id, path, name, url, last_modified, length, content, partial, error: a row for each file, whatever its size.

    Of a file above full_limit only the parts that hold its metadata are read. A file that is of use as a whole only, and
    larger than max_full, has an error. content is read only where it is used.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    if most is not None:
        first = df.select("path").orderBy("path").limit(most)
        df = df.join(F.broadcast(first), "path", "left_semi")
    whole = df.where(F.col("length") <= full_limit).withColumn("partial", F.lit(None).cast(PARTIAL)).withColumn("error", F.lit(None).cast("string"))
    large = df.where(F.col("length") > full_limit).select("path", "modificationTime", "length")
    read = to_arrow_schema(StructType.fromDDL(READ))

    def run(batches):
        for batch in batches:
            for k, name in enumerate(batch.column("path").to_pylist()):  # one file is held at a time
                row = {"content": None, "partial": None, "error": None}
                try:
                    row["content"], row["partial"] = load_source(FileSource(name), full_limit, max_full)
                except (OSError, ValueError) as e:
                    row["error"] = str(e)
                own = pa.RecordBatch.from_pylist([row], schema=read)
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, *own.columns], [*batch.schema.names, *read.names])

    parts = large.mapInArrow(run, f"path string, modificationTime timestamp, length long, {READ}")
    both = whole.unionByName(parts)
    return both.select(F.col("path").alias("file_id"), "path", native.name_from_url("path").alias("name"), F.col("path").alias("url"), native.stamp("modificationTime").alias("last_modified"), "length", "content", "partial", "error")
