"""Keyed state of streams: tabs that show media now, and keys that expire; and streams cut into batches.

State is kept by key, so each batch costs what it holds, and a key that is cleared leaves nothing behind. Within a batch
a key's rows are taken in their order; across batches the order of arrival counts. A key's rows of one batch pass
through one task as a stream of frames; what is kept of them is one row.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.relational import last_wins
from ..sources.shared import scratch

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "tab_id long, url string, mime string, removed boolean"


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that arbitrary state needs, for queries that start here; the session's own comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class _Tabs(StatefulProcessor):
    """A tab's state is what its last event shows, if that is media; closing the tab, or showing something else, removes it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shown = handle.getValueState("shown", "url string, mime string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = None
        for frame in rows:
            top = frame.sort_values(["at", "tie"], kind="stable", na_position="first").iloc[-1]
            last = top if last is None or _place(top) >= _place(last) else last
        if last is None:
            return
        had = self.shown.exists()
        if last["media"] and not last["closed"]:
            self.shown.update((last["url"], last["mime"]))
            yield pd.DataFrame({"tab_id": [key[0]], "url": [last["url"]], "mime": [last["mime"]], "removed": [False]})
        elif had:
            self.shown.clear()
            yield pd.DataFrame({"tab_id": [key[0]], "url": [None], "mime": [None], "removed": [True]})

    def close(self) -> None:
        pass


def _place(row) -> tuple:
    return (not pd.isna(row["at"]), row["at"] if not pd.isna(row["at"]) else pd.Timestamp(0), -1 if pd.isna(row["tie"]) else row["tie"])


def tab_changes(events: DataFrame, media, at: str = "ts", tie: str = "event_id") -> DataFrame:
    """tab_id, url, mime, removed: what each batch changes in the tabs that show media. events: tab_id, url, mime, closed, and their order (null first).

    media: a condition on mime. Events without a tab have no state. Write it in update mode, started within keyed_state().
    """
    rows = events.where("tab_id IS NOT NULL").select(F.col("tab_id").cast("long").alias("tab_id"), "url", "mime", F.coalesce("closed", F.lit(False)).alias("closed"), F.coalesce(media, F.lit(False)).alias("media"), F.col(at).alias("at"), F.col(tie).cast("long").alias("tie"))
    return rows.groupBy("tab_id").transformWithStateInPandas(_Tabs(), outputStructType=CHANGES, outputMode="Update", timeMode="None")


def tabs_now(changes: DataFrame, batch: str = "batch") -> DataFrame:
    """tab_id, url, mime of tabs that are there after all changes, by the number of their batch."""
    return last_wins(changes, ["tab_id"], [batch]).where("NOT removed").select("tab_id", "url", "mime")


class _Expiring(StatefulProcessor):
    """The last put of each key, until its time is over: then it goes out once and leaves no state."""

    def __init__(self, ttl_ms: int, by_event: bool):
        self.ttl, self.by_event = ttl_ms, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.saved = handle.getValueState("saved", "item long, at long")

    def _gone(self, key, items, ats) -> pd.DataFrame:
        return pd.DataFrame({"key": key[0], "item": items, "saved_at": pd.to_datetime(ats, unit="ms", utc=True)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.saved.get()
        item, at = (np.concatenate(c) for c in zip(*((f["item"].astype("int64").to_numpy(), f["at_ms"].astype("int64").to_numpy()) for f in rows), strict=True))
        if not self.by_event:
            at = np.full(len(item), timerValues.getCurrentProcessingTimeInMs())
        order = np.lexsort((item, at))
        item, at = item[order], at[order]
        if held:
            since = np.searchsorted(at, held[1])  # before it are older puts than the one that holds
            item, at = np.append(held[0], item[since:]), np.append(held[1], at[since:])
        over = np.flatnonzero(np.diff(at) > self.ttl)
        self.saved.update((int(item[-1]), int(at[-1])))
        if not held:
            self.handle.registerTimer(int(at[-1]) + self.ttl + 1)
        if len(over):
            yield self._gone(key, item[over], at[over])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """A key has one timer, of the put that came first; where a later one holds by now, it is set anew."""
        item, at = self.saved.get()
        now = timerValues.getCurrentWatermarkInMs() if self.by_event else timerValues.getCurrentProcessingTimeInMs()
        if at + self.ttl < now:
            self.saved.clear()
            yield self._gone(key, [item], [at])
        else:
            self.handle.registerTimer(at + self.ttl + 1)

    def close(self) -> None:
        pass


def expired(puts: DataFrame, ttl: datetime.timedelta, at: str | None = None, late: str = "1 second") -> DataFrame:
    """key, item, saved_at of each put that outlives ttl without a later put of its key. puts: key, item (longs), and with `at` their time.

    With `at`, time is the events' own: a key goes when the watermark, or the key's next put, is more than ttl later;
    puts older than the one that holds change nothing. The watermark follows the latest put by `late`; Spark drops puts
    that are not after it. Without `at`, time is the clock's, and the query runs until it is stopped, since time goes on:
    start it with a processing-time trigger. A put without a key or a time is
    left out. Write it in append mode (update, without `at`), started within keyed_state().
    """
    ms = int(ttl.total_seconds() * 1000)
    if at:
        rows = puts.where(F.col("key").isNotNull() & F.col(at).isNotNull()).withColumn("fg_at", F.col(at).cast("timestamp")).withWatermark("fg_at", late)
        rows = rows.select(F.col("key").cast("long").alias("key"), F.col("item").cast("long").alias("item"), F.unix_millis("fg_at").alias("at_ms"), "fg_at")
    else:
        rows = puts.where("key IS NOT NULL").select(F.col("key").cast("long").alias("key"), F.col("item").cast("long").alias("item"), F.lit(0).cast("long").alias("at_ms"))
    return rows.groupBy("key").transformWithStateInPandas(_Expiring(ms, bool(at)), outputStructType="key long, item long, saved_at timestamp", outputMode="Append" if at else "Update", timeMode="EventTime" if at else "ProcessingTime")


def run_in_batches(parts: list[DataFrame], start: Callable[[DataFrame, str], None]) -> None:
    """Each part is one batch of a stream, in order: it is written where the stream reads, and start(stream, checkpoint) runs the query over what is new.

    The query starts again for each batch, from its checkpoint, as after a failure.
    """
    spark = parts[0].sparkSession
    base = scratch(spark, "batches")
    for k, part in enumerate(parts):
        part.write.parquet(f"{base}/in/part={k}")
        stream = spark.readStream.schema(part.schema).parquet(f"{base}/in/part=*")
        start(stream, f"{base}/checkpoint")


def changes_of(parts: list[DataFrame], make: Callable[[DataFrame], DataFrame], mode: str = "update") -> DataFrame:
    """What a stream of keyed state puts out over batches, with the number of its batch. A batch that is repeated writes its own folder again."""
    spark = parts[0].sparkSession
    out = scratch(spark, "changes")
    schema = []

    def start(stream: DataFrame, checkpoint: str) -> None:
        made = make(stream)
        schema[:] = [made.schema]
        keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        made.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    with keyed_state(spark):
        run_in_batches(parts, start)
    return spark.read.schema(schema[0].add("batch", "long")).parquet(out)
