"""A store of blobs by key with a time to live, as a Parquet table: puts append, the last put of a key holds."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import last_wins

SCHEMA = "key string, blob binary, saved_at timestamp, deleted boolean"
TTL_SECONDS = 3600


def unexpired(df: DataFrame, saved_at: str, now, ttl: int = TTL_SECONDS) -> DataFrame:
    """Rows not older than ttl seconds at a time."""
    return df.where(F.col(saved_at) >= F.lit(now) - F.expr(f"INTERVAL {int(ttl)} SECONDS"))


class TransferStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _append(self, df: DataFrame) -> None:
        df.select("key", "blob", "saved_at", "deleted").write.mode("append").parquet(f"{self.path}/log")

    def put(self, rows: DataFrame, now: datetime.datetime | None = None) -> None:
        """rows: key, blob."""
        self._append(rows.withColumn("saved_at", F.lit(now) if now else F.current_timestamp()).withColumn("deleted", F.lit(False)))

    def delete(self, keys: DataFrame, now: datetime.datetime | None = None) -> None:
        self._append(keys.select("key", F.lit(None).cast("binary").alias("blob"), (F.lit(now) if now else F.current_timestamp()).alias("saved_at"), F.lit(True).alias("deleted")))

    def rows(self) -> DataFrame:
        log = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/log")
        return last_wins(log, ["key"], ["saved_at", "deleted"]).where(~F.col("deleted")).drop("deleted")

    def get(self, keys: list[str]) -> DataFrame:
        return self.rows().where(F.col("key").isin(keys))

    def prune(self, now: datetime.datetime | None = None, ttl: int = TTL_SECONDS) -> str:
        """Write what hasn't expired as a new log; returns its path, from which a new store reads."""
        kept = unexpired(self.rows(), "saved_at", now or datetime.datetime.now(datetime.UTC), ttl).withColumn("deleted", F.lit(False))
        target = f"{self.path}-{uuid.uuid4().hex}"
        kept.write.parquet(f"{target}/log")
        return target
