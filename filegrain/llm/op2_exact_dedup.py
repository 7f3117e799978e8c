"""Exact dedup with a Golomb-coded fingerprint exchange.

Each part of the fingerprints (a row of some 50 bytes for a document, dealt by a hash) sends its sorted distinct
64-bit fingerprints, Golomb coded, to the owners of fingerprint ranges, and receives a bitmap of those that
another part sent as well. Only documents whose fingerprint is doubled, here or elsewhere, are suspects; their
normalised texts alone are shuffled and compared byte by byte, in an aggregation that combines before its
shuffle, so a text that fills a third of all rows costs each map task one row.

Texts are equal when identical after each run of white space became one space. Defined results: null text is
the empty text. Rows that repeat id and text are members each; one of them can be the kept one. A null id is
kept only if no row with the same text has an id. Very long texts are hashed and compared whole. An empty table gives
an empty one. Other columns of docs, whatever their names, are not read. The texts are read twice: for the
fingerprints, and the suspects' to be compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, SPACE, bucket_cuts, checkpointed, golomb, pick, table, ungolomb

#: Suspect ids (16 bytes each) up to this number go to every task; more of them are joined by a shuffle.
BROADCAST_ROWS = 500_000
LEAST_ROWS = 250_000
BLOB = "part long, bucket long, n long, blob binary"
REPLY = "part long, bucket long, n long, bits binary"
PRINT = "doc_id long, fp long, sha binary, copies long"


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def _own_bits(fps: pa.ChunkedArray) -> np.ndarray:
    return fps.to_numpy().astype(np.int64).view(np.uint64)


def suspects(prints: DataFrame, part_rows: int | None = None) -> DataFrame:
    """prints (PRINT) with suspect: does another row or part hold the same fingerprint?

    A part has LEAST_ROWS rows at least, and the root of 64 times all: then it sends 64 fingerprints to each owner.
    """
    spark, n = prints.sparkSession, prints.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / (part_rows or max(LEAST_ROWS, math.isqrt(64 * n)))))
    by_part = prints.select(F.pmod(F.xxhash64("doc_id", "fp"), F.lit(parts)).alias("part"), *prints.columns).groupBy("part")

    def send(key: tuple, t: pa.Table) -> pa.Table:
        values = np.unique(_own_bits(t.column("fp")))
        cuts = bucket_cuts(values, parts, 64)
        full = [b for b in range(parts) if cuts[b + 1] > cuts[b]]
        return pa.table({"part": pa.array([key[0].as_py()] * len(full), pa.int64()), "bucket": pa.array(full, pa.int64()), "n": pa.array([int(cuts[b + 1] - cuts[b]) for b in full], pa.int64()), "blob": pa.array([golomb(values[cuts[b] : cuts[b + 1]]) for b in full], pa.binary())})

    def own(t: pa.Table) -> pa.Table:
        got = t.to_pylist()
        _, index, counts = np.unique(np.concatenate([ungolomb(r["blob"]) for r in got]), return_inverse=True, return_counts=True)
        ends = np.cumsum([r["n"] for r in got])
        flags = np.split(counts[index] > 1, ends[:-1])
        return pa.table({"part": pa.array([r["part"] for r in got], pa.int64()), "bucket": pa.array([r["bucket"] for r in got], pa.int64()), "n": pa.array([r["n"] for r in got], pa.int64()), "bits": pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())})

    def mark(t: pa.Table, replies: pa.Table) -> pa.Table:
        fps, copies = _own_bits(t.column("fp")), t.column("copies").to_numpy()
        values, index = np.unique(fps, return_inverse=True)
        rows = sorted(replies.to_pylist(), key=lambda r: r["bucket"])
        elsewhere = np.concatenate([*(np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]) for r in rows), np.zeros(0, np.uint8)])
        here = np.bincount(index, weights=copies, minlength=len(values)) > 1
        return t.select(["doc_id", "fp", "sha", "copies"]).append_column("suspect", pa.array((elsewhere.astype(bool) | here)[index]))

    replies = by_part.applyInArrow(send, BLOB).groupBy("bucket").applyInArrow(own, REPLY)
    return by_part.cogroup(replies.groupBy("part")).applyInArrow(mark, f"{PRINT}, suspect boolean")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id (smallest id with the same text), group_size, kept, text_sha256 (of the normalised text); a row for each row of docs."""
    rows = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    norm = rows.select("doc_id", normalised().alias("norm"))
    prints = norm.select("doc_id", F.xxhash64("norm").alias("fp"), F.unhex(F.sha2(F.encode("norm", "UTF-8"), 256)).alias("sha"))
    prints = checkpointed(prints.groupBy("doc_id", "fp", "sha").agg(F.count("*").alias("copies")))
    marked = checkpointed(suspects(prints))

    key = F.coalesce("doc_id", F.lit(int(NULL_ID)))
    wanted = marked.where("suspect").select(key.alias("key")).distinct()
    if marked.where("suspect").count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = rows.withColumn("key", key).join(wanted, "key", "left_semi").select("doc_id", normalised().alias("norm"))
    equal = texts.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    equal = equal.select(F.unhex(F.sha2(F.encode("norm", "UTF-8"), 256)).alias("same"), "keep_id", "group_size")

    joined = marked.join(equal, marked["sha"] == equal["same"], "left")
    out = joined.select("doc_id", F.when(F.col("same").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.lower(F.hex("sha")).alias("text_sha256"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW same AS (PARTITION BY t)
"""
