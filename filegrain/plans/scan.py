"""The lifecycles: scan pages and rank what their files hold; analyse files, clean them and verify the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import native
from ..operators.cleaning import clean_files
from ..operators.extraction import extract
from ..operators.relational import verified
from ..sources.pages import page_items


def scan_state(items: DataFrame, files: DataFrame) -> DataFrame:
    """Items with what is known of their files: report, error, or neither (pending). items: item_seq, url; files: url, content, error."""
    reports = extract(files.where("content IS NOT NULL").withColumn("file_id", F.col("url"))).drop("info.url")
    failed = files.where("error IS NOT NULL").select(F.col("url").alias("file_id"), "error")
    joined = items.join(reports, items["url"] == reports["file_id"], "left").drop("file_id")
    return joined.join(failed, joined["url"] == failed["file_id"], "left").drop("file_id")


def scan_pages(pages: DataFrame, files: DataFrame) -> DataFrame:
    """pages -> items -> files' reports, ranked: one row an item with severity."""
    items = page_items(pages).withColumn("item_seq", F.col("ord"))
    return scan_state(items, files).withColumn("name", native.name_from_url("url")).withColumn("severity", native.severity("flags"))


def clean_and_verify(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reports before, cleaning results, and for each finding whether it is gone from the cleaned bytes."""
    before, cleaned = extract(files), clean_files(files)
    again = extract(cleaned.where("bytes IS NOT NULL").select("file_id", F.col("bytes").alias("content")))
    done = before.join(cleaned.where("bytes IS NOT NULL").select("file_id"), "file_id", "left_semi")
    return before, cleaned, verified(done, again)
