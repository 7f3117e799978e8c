"""Stages on rows in another order, with null and repeated ids, and on lines of measured frequencies."""

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from filegrain.llm import op4_line_dedup, op9_mixing


def test_tokens_are_in_the_order_of_the_mix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    mix = op9_mixing.mixed(docs, op9_mixing.SHARES)
    want = [r["doc_id"] for r in sorted(mix.collect(), key=lambda r: (r["fg_slot"], r["fg_key"]))]
    for order in (F.col("n_chars").desc(), F.col("doc_id")):  # as Spark orders what it reads, or any other
        got = corpus_pipeline.tokens(spark, docs.repartitionByRange(3, order).sortWithinPartitions(order), None)
        assert [r["doc_id"] for r in got.collect()] == want


def test_a_line_goes_from_all_sources_or_none(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    often = "The and attion to thanedble the, anea."
    had = {r["source"] for r in docs.where(F.col("text").contains(often)).select("source").distinct().collect()}
    line = F.exists(F.split("text", "\n"), lambda x: F.trim(x).startswith(often))
    left = corpus_pipeline.lines(spark, docs, None).where(line).select("source").distinct().collect()
    assert len(had) == 20 and not left


def test_pages_by_host(spark):
    html = "<html><head><style>p{}</style><script>var t='</p>';</script></head><body><nav><a href='/'>Home</a></nav><!-- <p>no -->"
    pages = [(k, f"https://user@Site.example:80/{k}?q", f"{html}<p>own <b>text</b>\n{k}<br>second {k}</div></body></html>") for k in range(6)]
    pages += [(6, "https://other.example/", f"{html}<p>alone</p>"), (7, None, None)]
    out = op4_line_dedup.page_lines(spark.createDataFrame(pages, "page_id long, url string, html string"))
    rows = {r["page_id"]: r for r in op4_line_dedup.drop_boilerplate(out, "page_id", "site").collect()}
    assert all(rows[k]["site"] == "site.example" and rows[k]["text"] == f"own text {k}\nsecond {k}" and rows[k]["fg_dropped"] == 1 for k in range(6))
    assert rows[6]["text"] == "Home\nalone" and rows[7]["site"] is None and rows[7]["text"] == ""


def test_null_and_repeated_ids_are_judged_by_row(spark):
    good, junk = " ".join(f"word{k}" for k in range(20)), "too short"
    rows = [(1, good, "en"), (1, junk, "en"), (None, good, "en"), (None, junk, "en"), (None, None, None), (2, junk, None), (3, good, None)]
    docs = spark.createDataFrame([(*r, "src0", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.quality(spark, docs, None).collect()]
    assert sorted(kept, key=str) == sorted([(1, good), (None, good), (3, good)], key=str)


def test_lines_by_host_match_sql(spark):
    at = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{at}/pages.parquet'")
    got = [tuple(r[c] for c in ("page_id", "site", "n_lines", "n_dropped", "kept_sha256")) for r in op4_line_dedup.query_pages(spark, at).collect()]
    want = con.execute(f"SELECT page_id, site, n_lines, n_dropped, kept_sha256 FROM ({op4_line_dedup.ORACLE_PAGES})").fetchall()
    assert sorted(got) == sorted(want) and sum(r[3] for r in got) > 100
