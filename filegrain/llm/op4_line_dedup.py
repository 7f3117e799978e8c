"""Line dedup by site-relative frequency.

Within a site (host or source) a line's frequency is the number of the site's pages that contain it, divided by
the number of the site's pages. Lines above a ratio are the site's boilerplate and are dropped from all its pages.

Lines are cut at \\n and compared after trimming white space; blank lines are never counted or dropped. A page
counts once for a line, however often it repeats it. Counting groups by (site, 64-bit hash of the line) with a
combine before the shuffle, so neither a hot site nor a hot line gathers in a task. A site has fewer boilerplate
lines than its mean number of lines a page divided by the ratio, which bounds the list that is joined to its
pages: as a broadcast if all lists together have at most BROADCAST_HASHES entries, else by a shuffle on the site,
whose large partitions Spark splits.

Defined results: null text is the empty text (one blank line). A null site is a site like any other, the same as
an empty name. Rows that repeat an id are pages each. A line at exactly the ratio stays. Very long texts are cut whole;
an empty table gives an empty one. What is added has a prefix that no column of docs has, so all of these stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at, checkpointed, named, numbered, own_prefix, pick, table

RATIO = 0.1
#: A line on fewer pages than this is never boilerplate: on a site of nine pages each line has a ratio above 0.1. A parameter; 1 turns it off.
MIN_PAGES = 5
#: The same for hosts of web pages: no two pages of a host share a line by chance that is a passage of its own.
HOST_PAGES = 2
BROADCAST_HASHES = 500_000
#: The ratio for sources of documents as sites. On sf0.1 documents past the quality stage one line has 8.8 to 14.1 % of each
#: source's pages and any other at most 5.3 % of one's, so no line is dropped in some sources and kept in others.
SOURCE_RATIO = 0.065
#: Tags that end a line of a page.
BLOCK_TAGS = "address article aside blockquote body br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split()
PAGE_CUT = rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})\b[^>]*>"


def _lines(text: str):
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _hashed(line):
    return F.xxhash64(F.trim(line, F.lit(" \t\n\r\x0b\x0c")))


def _blank(line):
    return F.trim(line, F.lit(" \t\n\r\x0b\x0c")) == ""


def boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """site, hashes: the line hashes that are boilerplate on the site. Sites without any are left out."""
    rows = pick(docs, site=(site_col, "string"), text=(text_col, "string")).withColumn("site", F.coalesce("site", F.lit("")))
    totals = rows.groupBy("site").agg(F.count("*").alias("pages"))
    own = F.array_distinct(F.transform(F.filter(_lines("text"), lambda x: ~_blank(x)), _hashed))
    counts = rows.select("site", F.explode(own).alias("line")).groupBy("site", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    common = counts.join(totals, "site").where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return common.groupBy("site").agg(F.collect_list("line").alias("hashes"))


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with text_col cleaned, and fg_lines, fg_dropped (numbers of lines before, and dropped). A row for each row."""
    rules = checkpointed(boilerplate(docs, site_col, text_col, ratio, min_pages))
    size = rules.agg(F.sum(F.size("hashes"))).first()[0] or 0
    text, prefix = at(docs, text_col), own_prefix(docs)
    rows = numbered(docs).withColumn("site", F.coalesce(F.col(at(docs, site_col)).cast("string"), F.lit("")))
    joined = rows.join(F.broadcast(rules) if size <= BROADCAST_HASHES else rules, "site", "left")
    lines = _lines(text)
    kept = F.when(F.col("hashes").isNull(), lines).otherwise(F.filter(lines, lambda x: _blank(x) | ~F.array_contains("hashes", _hashed(x))))
    joined = joined.withColumn("kept", kept).withColumn("lines", F.size(lines).cast("long"))
    joined = joined.withColumn("dropped", F.col("lines") - F.size("kept")).withColumn(text, F.array_join("kept", "\n"))
    return named(docs, joined, F.col("lines").alias(f"{prefix}lines"), F.col("dropped").alias(f"{prefix}dropped"))


def page_lines(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with site (the host, null without one) and text: what is outside tags, scripts, styles and comments, cut into lines at block tags."""
    host = F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    text = F.regexp_replace(F.col(html_col), r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\n\f\r]+", " "), PAGE_CUT, "\n")
    text = F.regexp_replace(F.regexp_replace(text, "<[^>]*>", ""), r" *\n[ \n]*", "\n")
    return pages.withColumn("site", F.when(host != "", host)).withColumn("text", F.trim(text, F.lit(" \n")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id=("doc_id", "long"), source=("source", "string"), text=("text", "string"))
    out = drop_boilerplate(docs)
    return out.select("doc_id", F.col("fg_lines").alias("n_lines"), F.col("fg_dropped").alias("n_dropped"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def query_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by host over web pages, whose lines are cut at block tags."""
    pages = pick(table(spark, sf_dir, "pages"), page_id=("page_id", "long"), url=("url", "string"), html=("html", "string"))
    out = drop_boilerplate(page_lines(pages), "page_id", "site", min_pages=HOST_PAGES)
    return out.select("page_id", "site", F.col("fg_lines").alias("n_lines"), F.col("fg_dropped").alias("n_dropped"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def _oracle(rows: str, id: str, min_pages: int) -> str:
    """SQL over rows: id, site, text."""
    return f"""
WITH d AS ({rows}), l AS (
  SELECT {id}, coalesce(site, '') AS key, site, line, trim(line, E' \\t\\n\\r\\x0b\\x0c') AS t, i
  FROM (SELECT {id}, site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM d)
), p AS (SELECT coalesce(site, '') AS key, count(*) AS pages FROM d GROUP BY 1
), c AS (
  SELECT key, t FROM (SELECT key, t, count(DISTINCT {id}) AS n FROM l WHERE t <> '' GROUP BY key, t) JOIN p USING (key)
  WHERE n >= {min_pages} AND n > {RATIO}::DOUBLE * pages
)
SELECT {id}, {"site, " if id == "page_id" else ""}count(*) AS n_lines, count(c.t) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.t IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN c ON l.key = c.key AND l.t = c.t GROUP BY ALL
"""


ORACLE = _oracle("SELECT doc_id, source AS site, text FROM documents", "doc_id", MIN_PAGES)
_CUT = rf"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'), '[ \t\n\f\r]+', ' ', 'g'), '{PAGE_CUT}', chr(10), 'g')"
ORACLE_PAGES = _oracle(rf"SELECT page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '') AS site, trim(regexp_replace(regexp_replace({_CUT}, '<[^>]*>', '', 'g'), ' *\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS text FROM pages", "page_id", HOST_PAGES)
