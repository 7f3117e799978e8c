"""What is known of a scan that still runs: the best rows and the sums, kept from batch to batch.

A snapshot is a list of at most `most` rows and one row of sums; the next one is made of it and a batch alone, so a batch
costs what it holds, whatever came before. Snapshots are stored under their batch's number, and batch n is merged
into snapshot n - 1: a batch that comes again makes the same snapshot again. The last two are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import ranked, scan_summary
from ..sources.shared import removed

MOST = 1000


class Snapshots:
    def __init__(self, spark: SparkSession, path: str, most: int = MOST, seq: str = "item_seq"):
        self.spark, self.path, self.most, self.seq = spark, path.rstrip("/"), most, seq

    def _at(self, what: str, number: int) -> str:
        return f"{self.path}/{what}/{number}"

    def merge(self, batch: DataFrame, number: int) -> None:
        """batch: reports with flags, gps, error and their place in the input, each once in all batches."""
        rows, sums = ranked(batch, self.seq), scan_summary(batch)
        if number > 0:
            rows = rows.unionByName(self.spark.read.schema(rows.schema).parquet(self._at("rows", number - 1)))
            sums = sums.unionByName(self.spark.read.schema(sums.schema).parquet(self._at("sums", number - 1)))
        rows.orderBy(F.desc("severity"), F.asc(self.seq)).limit(self.most).write.mode("overwrite").parquet(self._at("rows", number))
        sums.agg(*[F.sum(c).alias(c) for c in sums.columns]).write.mode("overwrite").parquet(self._at("sums", number))
        if number > 1:
            for what in ("rows", "sums"):
                removed(self.spark, self._at(what, number - 2))

    def rows(self, number: int) -> DataFrame:
        """The best rows after that batch, best first."""
        return self.spark.read.parquet(self._at("rows", number)).orderBy(F.desc("severity"), F.asc(self.seq))

    def summary(self, number: int) -> DataFrame:
        return self.spark.read.parquet(self._at("sums", number))
