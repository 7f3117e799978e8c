"""An index for field search: which rows hold which three characters, stored by groups of them.

A search reads the groups of its own trigrams alone, takes the rows that hold all of them, and looks at those rows' fields.
Folding is field_search's own (lower case by Turkish rules), so both find the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .relational import field_search, folded

FIELDS = ("k", "v", "section_title")
BUCKETS = 256
END = "\n\x00\n"  # between fields, so that no trigram of a query reaches over


def trigrams(text: Column) -> Column:
    """The distinct stretches of three characters, by one pass of a look-ahead; none for shorter texts."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1)))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def write_index(rows: DataFrame, row_id: str, path: str, buckets: int = BUCKETS) -> None:
    """Postings of long rows (k, v, section_title) by their number row_id. A file of a group has its trigrams in order, so that a reader skips row groups."""
    text = folded(F.concat_ws(END, *FIELDS))
    posts = rows.select(F.col(row_id).cast("long").alias("row"), F.explode(trigrams(text)).alias("gram")).withColumn("bucket", _bucket(F.col("gram"), buckets))
    posts.repartition("bucket", F.pmod("row", F.lit(8))).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(path)


def candidates(spark: SparkSession, path: str, query: str, buckets: int = BUCKETS) -> DataFrame | None:
    """row: rows that hold all trigrams of the query; None if it is too short to have one."""
    grams, wanted = spark.range(1).select(trigrams(folded(F.lit(query))).alias("g")).select("g", F.transform("g", lambda x: _bucket(x, buckets))).first()
    if not grams:
        return None
    posts = spark.read.schema("row long, gram string, bucket int").parquet(path)
    met = posts.where(F.col("bucket").isin(*sorted(set(wanted))) & F.col("gram").isin(*grams))
    return met.groupBy("row").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("row")


def indexed_search(rows: DataFrame, row_id: str, path: str, query: str, buckets: int = BUCKETS) -> DataFrame:
    """field_search by an index that write_index() made of the same rows. Queries of fewer than three characters look at all rows."""
    found = candidates(rows.sparkSession, path, query, buckets)
    return field_search(rows if found is None else rows.join(found.withColumnRenamed("row", "fg_row"), F.col(row_id).cast("long") == F.col("fg_row"), "left_semi"), query)
