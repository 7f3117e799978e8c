"""State of browser tabs, and scan results that come in over time, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import native
from ..sources.shared import scratch
from .snapshots import MOST, Snapshots

MEDIA = r"^(image/|video/|audio/|application/(x-)?pdf)"


def is_media(mime) -> Column:
    return F.coalesce((F.col(mime) if isinstance(mime, str) else mime).rlike(MEDIA), F.lit(False))


def tab_state(events: DataFrame, order: str = "ts") -> DataFrame:
    """tab_id, url, mime of tabs that show media now: the last event of each tab, unless it cleared the state.

    events: tab_id, url, mime, closed, and a time. For a stream, write it in complete mode: the state is one row a tab.
    """
    last = events.groupBy("tab_id").agg(F.max_by(F.struct("url", "mime", "closed"), F.col(order)).alias("x"))
    return last.where(is_media("x.mime") & ~F.coalesce("x.closed", F.lit(False))).select("tab_id", "x.url", "x.mime")


def badges(results: DataFrame) -> DataFrame:
    """tab_id, text, color for each result event: a stateless map."""
    return results.select("tab_id", native.badge("mime", "flags").alias("b")).select("tab_id", "b.text", "b.color")


def progressive(results: DataFrame, show: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, trigger: dict | None = None, most: int = MOST, path: str | None = None):
    """Start a query that, after each batch of results, shows the best of all results so far and their sums. Returns the query.

    show(rows, summary, number): at most `most` rows. path: where snapshots are kept, beside the checkpoint if not given.
    """
    kept = Snapshots(results.sparkSession, path or f"{checkpoint.rstrip('/')}-snapshots", most)

    def each(batch: DataFrame, number: int) -> None:
        kept.merge(batch, number)
        show(kept.rows(number), kept.summary(number), number)

    writer = results.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def run_to_table(changing: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a streaming DataFrame over all that is available now, and return its result as a table: the last one, or with mode append all rows.

    A batch that is repeated writes its own folder again, so no row comes twice.
    """
    spark = changing.sparkSession
    base = scratch(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/result/batch={number if mode == 'append' else 0}")

    writer = changing.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(changing.schema).parquet(f"{base}/result").select(*changing.columns)
