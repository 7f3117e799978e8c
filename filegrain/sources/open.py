"""Files by URL of any kind, in one schema: paths, http(s) through range requests, data: by expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import native
from .files import read_files
from .http_range import NAMES, SCHEMA, fetch
from .partial import PARTIAL, FileSource, load_source
from .plan import FULL_LIMIT, HARD_LIMIT

COLUMNS = ("file_id", "url", "name", "final_url", "referrer", "content_type", "headers", "last_modified", "length", "content", "partial", "via_background", "error")
WEB = ("http://", "https://")


def _shaped(df: DataFrame) -> DataFrame:
    """All of COLUMNS, those that df lacks as nulls."""
    kinds = {"headers": "map<string,string>", "length": "bigint", "content": "binary", "partial": PARTIAL, "via_background": "boolean"}
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


def _opened(url: str, referer: str | None, full_limit: int, max_full: int) -> dict:
    """A row of the http_range schema for an address of any kind but data:."""
    if url.lower().startswith(WEB):
        return fetch(url, referer, full_limit, max_full)
    row: dict = {"url": url, "via_background": False}
    if url.startswith("blob:"):
        return row | {"error": "Could not read in-page data: blob: URLs exist only inside their page"}
    try:
        source = FileSource(url)
        content, partial = load_source(source, full_limit, max_full)
        return row | {"content": content, "partial": partial, "length": source.size}
    except (OSError, ValueError) as e:
        return row | {"error": str(e)}


def read_url_table(urls: DataFrame, url_col: str = "url", referer: str | None = None, full_limit: int = FULL_LIMIT, max_full: int = HARD_LIMIT) -> DataFrame:
    """COLUMNS for each row of a table of URLs, read by its own partitions; those that can't be read have an error. A null URL is left out.

    Nothing of the table passes through the driver. Give it as many partitions as should read at a time.
    """
    rows = urls.select(F.col(url_col).cast("string").alias("url")).where("url IS NOT NULL")
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches):
        for batch in batches:
            for url in batch.column("url").to_pylist():  # one file is held at a time
                row = _opened(url, referer, full_limit, max_full)
                yield pa.RecordBatch.from_pylist([{n: row.get(n) for n in NAMES}], schema=schema)

    read = rows.where(~F.startswith(F.col("url"), F.lit("data:"))).mapInArrow(run, SCHEMA)
    read = read.withColumn("file_id", F.col("url")).withColumn("name", F.when(F.startswith(F.col("url"), F.lit("blob:")), F.lit(None)).otherwise(native.name_from_url("url")))
    inline = rows.where(F.startswith(F.col("url"), F.lit("data:"))).withColumn("content", native.data_url_bytes("url"))
    kind = F.nullif(F.regexp_extract("url", "^data:([^;,]*)", 1), F.lit(""))
    inline = inline.withColumns({"file_id": F.col("url"), "name": native.name_from_url("url"), "content_type": kind, "length": F.length("content").cast("long")})
    return _shaped(read).unionByName(_shaped(inline))


def read_urls(spark: SparkSession, urls: list[str], referer: str | None = None, full_limit: int = FULL_LIMIT, max_full: int = HARD_LIMIT) -> DataFrame:
    """The same for a short list; paths in it may be folders and patterns, which Spark lists."""
    paths = [u for u in urls if "://" not in u and not u.startswith(("data:", "blob:")) or u.startswith("file:")]
    table = spark.createDataFrame([(u,) for u in urls if u not in paths], "url string").repartition(max(1, len(urls) - len(paths)))
    out = read_url_table(table, "url", referer, full_limit, max_full)
    return out.unionByName(_shaped(read_files(spark, paths, full_limit=full_limit, max_full=max_full))) if paths else out
