"""A corpus pipeline over documents: quality, boilerplate lines, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; other columns of docs stay as they are, also such as
differ from those in case alone. Defined results: rows are judged each by their own text, also those without a doc_id
and those that repeat one. A null or empty text fails the quality rules; where a stage gets one all the same it has no
lines to drop, is alike other empty ones, has no size in the mix, and no tokens. Very long texts are handled whole.
An empty table gives an empty one at each stage.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filegrain.llm import op4_line_dedup, op5_byte_bpe, op7_quality, op9_mixing, op10_similar
from filegrain.llm.common import pick, removed, scratch

CORE = ("doc_id", "text", "lang", "source", "n_chars")


def hidden(stage):
    """The stage over documents whose further columns, whatever their names, wait under names of their own."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = [f"further{k}" for k in range(len(docs.columns))]
        for c in CORE:
            if c in docs.columns:
                own[docs.columns.index(c)] = c
        out = stage(spark, docs.toDF(*own), sf_dir)
        return out.select(*[F.col(o).alias(c) for o, c in zip(own, docs.columns, strict=True)])

    return run_stage


@hidden
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return op7_quality.kept_rows(docs)


@hidden
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their site's boilerplate lines; n_chars follows the text."""
    out = op4_line_dedup.drop_boilerplate(docs, ratio=op4_line_dedup.SOURCE_RATIO)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@hidden
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates: 0.8 or more of their five-word shingles in common."""
    return op10_similar.one_of_each(docs, words=5, least=0.8)


@hidden
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of their slots: read in order, the files hold the sources at their target weights."""
    return op9_mixing.Mix(docs, op9_mixing.SHARES).arranged().select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, decoded_sha256 (of the bytes that the ids decode to), in the order of the mix.

    Files read again come in any order, so the slots, which follow from the documents alone, are computed again.
    """
    core = pick(docs, doc_id=("doc_id", "long"), source=("source", "string"), text=("text", "string"))
    out = op5_byte_bpe.encode(op9_mixing.Mix(core, op9_mixing.SHARES).arranged(), decoded=True)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("tokens", tokens)]

#: Neither the divergence, the near duplicates' components nor the tokens can be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What is between them is written below the cluster's shared folder, and goes once it isn't read any more: the last stage's input when the application ends."""
    docs, before = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := scratch(spark, f"pipeline-{k}-{name}"))
            docs = spark.read.parquet(path)
            if before:
                removed(spark, before)
            before = path
    return docs
