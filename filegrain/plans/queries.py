"""Queries over the driver's tables, one or more for each operator that SQL can express, with that SQL (DuckDB).

The tables hold no media files. Where an operator takes bytes, flags or parts, the query derives them from a table by
expressions that SQL can repeat.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import native as N
from ..operators import relational as R
from ..operators import dictionary, render, search
from ..operators.cleaning import svg_text
from ..operators.extract.pdf import PAPER
from ..operators.extraction import extract, metadata_rows
from ..sources import pages as P
from ..sources import log, ranges, saved
from ..sources.boxes import top_boxes
from ..sources.plan import planned, planned_boxes
from ..sources.shared import folder, scratch
from ..sources.store import unexpired
from ..streaming.state import changes_of, expired, run_in_batches, tab_changes, tabs_now
from ..streaming.tabs import badges as badges_of
from ..streaming.tabs import is_media, progressive, run_to_table, tab_state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- derived inputs

#: Flags of a document by patterns in its text: code, level, text, pattern (read alike by Java and DuckDB).
RULES = (
    ("secret", "danger", "Contains a secret", "(password|secret|token) *[:=]"),
    ("email", "warn", "Contains author contact", "[a-z0-9]@[a-z0-9]+[.][a-z]"),
    ("symbols", "warn", "Contains macro-like symbols", "[#$%*]{3}"),
    ("long", "info", "Many lines", "\n.*\n.*\n.*\n.*\n.*\n.*\n.*\n"),
)


def flagged(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """doc_id, source, flags of each document; of a stream, if one is given."""
    d = (T(spark, sf_dir, "documents") if documents is None else documents).select("doc_id", "source", "text", "n_chars")
    flags = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(c).alias("code"), F.lit(v).alias("level"), F.lit(t).alias("text"))) for c, v, t, p in RULES]), lambda f: f.isNotNull())
    return d.withColumn("flags", flags)


def _hit(i: int) -> str:
    return f"regexp_matches(text, '{RULES[i][3]}')"


SEVERITY = " + ".join(f"CASE WHEN {_hit(i)} THEN {dict(danger=100, warn=10, info=1)[RULES[i][1]]} ELSE 0 END" for i in range(len(RULES)))
FLAG_TEXTS = "list_filter([" + ", ".join(f"CASE WHEN {_hit(i)} THEN '{RULES[i][2]}' END" for i in range(len(RULES))) + "], lambda x: x IS NOT NULL)"


def as_reports(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """Documents in the shape of reports."""
    d = flagged(spark, sf_dir, documents)
    info = F.struct(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.lit("Text").alias("type_label"), F.col("n_chars").alias("size"), F.lit(None).cast("string").alias("title"))
    gps = F.when(F.col("doc_id") % 7 == 0, F.struct((F.col("doc_id") % 90).cast("int").alias("lat"), (F.col("doc_id") % 180).cast("int").alias("lon"), F.lit(None).cast("double").alias("alt")))
    row = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"), F.lit(False).alias("s"))
    sections = F.array(F.struct(F.lit("file").alias("id"), F.lit("File").alias("title"), F.array(row("Size", F.col("n_chars")), row("Source", F.col("source"))).alias("rows")))
    error = F.when(F.col("doc_id") % 11 == 0, F.lit("HTTP 404"))
    return d.select(F.col("doc_id").alias("item_seq"), F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string")).alias("url"), info.alias("info"), "flags", F.array(F.col("source")).alias("highlights"), F.array().cast("array<string>").alias("warnings"), gps.alias("gps"), F.lit(None).cast("binary").alias("thumbnail"), sections.alias("sections"), error.alias("error"))


# --- sources


@query(
    "s08_page_references",
    r"""WITH r AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\shref\s*=\s*["'']([^"'']+)["'']', 1)) AS ref,
             generate_subscripts(regexp_extract_all(html, '(?i)<a\b[^>]*?\shref\s*=\s*["'']([^"'']+)["'']', 1), 1) - 1 AS o FROM pages),
    a AS (SELECT page_id, o, CASE WHEN regexp_matches(ref, '^[A-Za-z][\w+.-]*:') THEN ref WHEN starts_with(ref, '/') THEN regexp_extract(base, '^(\w+://[^/?#]+)', 1) || ref
             ELSE rtrim(regexp_extract(base, '^(\w+://[^/?#]+(?:/[^?#]*/|/)?)', 1), '/') || '/' || ref END AS url FROM r),
    f AS (SELECT page_id, url, min(o) AS o FROM a WHERE regexp_matches(url, '^(https?:|data:)') AND length(url) <= 4096 GROUP BY 1, 2)
    SELECT page_id, url, 'link' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY o) AS n FROM f) WHERE n <= 200""",
)
def page_references(spark, sf_dir):
    items = P.page_items(T(spark, sf_dir, "pages"), only_files=False)
    return items.select("page_id", "url", "kind")


#: Elements that the query puts before a page: files, images of all sizes, media, backgrounds, and what is no file.
MARKUP = """<base href="/files/x/"><a href="report.pdf?v={k}&amp;w=1">r</a><a HREF=photo.JPG>p</a><a href="../up.docx#s">u</a><a href="page{k}.html">n</a><a href="mailto:a@b.c">m</a>
<img src="small.png" width="20" height="30"><img alt="x" src='wide.png' width=400 height=20><img src="/top.gif"><img src="//cdn.example/i{k}.png"><video src="v.mp4"></video><audio><source src="a.mp3"></audio><div style="color:red; background: url(&quot;bg.png&quot;)"></div><a href="report.pdf?v={k}&amp;w=1">again</a>"""
#: Of these, in order: kind, and URL below the host.
FOUND = (("img", "/files/x/wide.png"), ("img", "/top.gif"), ("img", "//cdn.example/i{k}.png"), ("media", "/files/x/v.mp4"), ("media", "/files/x/a.mp3"), ("link", "/files/x/report.pdf?v={k}&w=1"), ("link", "/files/x/photo.JPG"), ("link", "/files/up.docx#s"), ("bg", "/files/x/bg.png"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that begin with MARKUP."""
    page = F.replace(F.lit(MARKUP), F.lit("{k}"), F.col("page_id").cast("string"))
    return T(spark, sf_dir, "pages").select("page_id", "url", F.concat(page, "html").alias("html"))


_ORIGIN = r"regexp_extract(url, '^(\w+://[^/?#]+)', 1)"
_FOUND_SQL = ", ".join(f"{{'o': {o}, 'kind': '{k}', 'path': '{u}'}}" for o, (k, u) in enumerate(FOUND))
_FILES_SQL = rf"""SELECT page_id, host, o, kind, CASE WHEN path LIKE '//%' THEN regexp_extract(url, '^(\w+:)', 1) || path ELSE origin || path END AS url
    FROM (SELECT page_id, url, {_ORIGIN} AS origin, regexp_extract(url, '^\w+://([^/?#]+)', 1) AS host, x.o, x.kind, replace(x.path, '{{k}}', page_id::VARCHAR) AS path FROM (SELECT page_id, url, unnest([{_FOUND_SQL}]) AS x FROM pages))"""


@query("s08_page_files", f"SELECT page_id, kind, url FROM ({_FILES_SQL})")
def page_files(spark, sf_dir):
    return P.page_items(_marked(spark, sf_dir)).select("page_id", "kind", "url")


@query(
    "s09_union_files",
    f"""SELECT host, url, kind, page_id FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id, o) AS n
    FROM (SELECT host, url, arg_min(kind, (page_id, o)) AS kind, arg_min(o, (page_id, o)) AS o, min(page_id) AS page_id FROM ({_FILES_SQL}) GROUP BY host, url)) WHERE n <= 150""",
)
def union_files(spark, sf_dir):
    items = P.page_items(_marked(spark, sf_dir))
    pages = T(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^\w+://([^/?#]+)", 1).alias("host"))
    return P.union_frames(items.join(pages, "page_id"), "host", "page_id").select("host", "url", "kind", "page_id")


@query(
    "s09_union_frames",
    r"""WITH r AS (SELECT page_id, regexp_extract(url, '^\w+://([^/?#]+)', 1) AS host, regexp_extract(url, '^(\w+://[^/?#]+)', 1) AS root,
             unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\shref\s*=\s*["'']([^"'']+)["'']', 1)) AS ref,
             generate_subscripts(regexp_extract_all(html, '(?i)<a\b[^>]*?\shref\s*=\s*["'']([^"'']+)["'']', 1), 1) - 1 AS o FROM pages),
    a AS (SELECT host, page_id, o, root || ref AS url FROM r WHERE starts_with(ref, '/')),
    f AS (SELECT host, url, min(struct_pack(p := page_id, o := o)) AS first FROM a GROUP BY 1, 2)
    SELECT host, url, first.p AS page_id FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY first) AS n FROM f) WHERE n <= 150""",
)
def union_frames(spark, sf_dir):
    items = P.references(T(spark, sf_dir, "pages"), kinds=("link",)).where(F.col("ref").startswith("/"))
    items = items.withColumn("host", F.regexp_extract("url", r"^\w+://([^/?#]+)", 1))
    return P.union_frames(items, "host", "page_id").select("host", "url", "page_id")


TYPES_SQL = "CASE o_orderkey % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'mkv' WHEN 2 THEN 'jpeg' WHEN 3 THEN 'zip' WHEN 4 THEN 'mp4' END"


@query(
    "s13_scan_plan",
    f"""WITH f AS (SELECT o_orderkey, {TYPES_SQL} AS type, CAST(o_orderkey * 40013 + 1000 AS BIGINT) AS size FROM orders)
    SELECT o_orderkey, type, size,
      CAST(CASE WHEN type IS NULL OR size <= 67108864 OR type = 'zip' THEN size WHEN type = 'mp4' THEN NULL WHEN type = 'pdf' THEN least(size, 25165824)
           WHEN type = 'mkv' THEN 16777216 ELSE least(size, 17039360) END AS BIGINT) AS bytes_planned,
      CAST(CASE WHEN type IS NULL OR size <= 67108864 OR type IN ('zip', 'mkv') THEN 1 WHEN type = 'mp4' THEN NULL ELSE 2 END AS INT) AS n_parts FROM f""",
)
def scan_plan(spark, sf_dir):
    key = F.col("o_orderkey")
    kind = F.when(key % 6 == 0, "pdf").when(key % 6 == 1, "mkv").when(key % 6 == 2, "jpeg").when(key % 6 == 3, "zip").when(key % 6 == 4, "mp4")
    f = T(spark, sf_dir, "orders").select("o_orderkey", kind.alias("type"), (key * 40013 + 1000).cast("long").alias("size"))
    f = f.withColumn("parts", planned("type", "size"))
    return f.select("o_orderkey", "type", "size", R.bytes_read(F.col("parts")).alias("bytes_planned"), F.when(F.col("parts").isNotNull(), F.size("parts")).alias("n_parts"))


@query(
    "s13_box_plan",
    """WITH b AS (SELECT l_orderkey, l_linenumber, ['ftyp', 'moov', 'mdat', 'free', 'uuid', 'abcd'][1 + l_partkey % 6] AS name, CAST(CASE WHEN l_partkey % 7 = 0 THEN 16 ELSE l_quantity * l_partkey * 9000 + 8 END AS BIGINT) AS n, l_orderkey % 2 = 0 AS still FROM lineitem),
    p AS (SELECT *, n <= CASE WHEN name IN ('ftyp', 'moov', 'uuid') THEN 67108864 WHEN name IN ('mdat', 'free') THEN -1 ELSE 1048576 END AS small FROM b)
    SELECT l_orderkey, count_if(still OR small AND n > 16) AS n_parts, CAST(coalesce(sum(CASE WHEN small AND (still OR n > 16) THEN n WHEN still THEN 8 END), 0) AS BIGINT) AS bytes_planned FROM p GROUP BY l_orderkey""",
)
def box_plan(spark, sf_dir):
    """Each order as a file of ISO media whose boxes are its lines."""
    names = F.array(*map(F.lit, ("ftyp", "moov", "mdat", "free", "uuid", "abcd")))
    size = F.when(F.col("l_partkey") % 7 == 0, F.lit(16)).otherwise(F.col("l_quantity") * F.col("l_partkey") * 9000 + 8).cast("long")
    rows = T(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.get(names, (F.col("l_partkey") % 6).cast("int")).alias("name"), size.alias("n")).alias("b"))
    files = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("b")).alias("b"))  # an order has seven lines at most
    ends = F.aggregate("b", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["n"])))
    boxes = F.zip_with(F.col("b"), F.slice("ends", 1, F.size("b")), lambda x, s: F.struct(x["name"].alias("name"), s.alias("s"), (s + x["n"]).alias("e"), F.lit(8).alias("head")))
    out = files.withColumn("ends", ends).withColumn("parts", planned_boxes(boxes, F.col("l_orderkey") % 2 == 0))
    return out.select("l_orderkey", F.size("parts").cast("long").alias("n_parts"), R.bytes_read(F.col("parts")).alias("bytes_planned"))


@query(
    "s10_box_walk",
    """WITH RECURSIVE f AS (SELECT l_orderkey AS file, string_agg(CASE WHEN l_partkey % 9 = 0 THEN '00000001' || hex(k) || printf('%016X', 16 + n) WHEN l_partkey % 41 = 0 THEN printf('%08X', l_partkey % 8) || hex(k) ELSE printf('%08X', 8 + n) || hex(k) END || repeat('00', n), '' ORDER BY l_linenumber, l_partkey, l_quantity) AS h
      FROM (SELECT *, CAST(l_quantity AS INT) AS n, ['ftyp', 'moov', 'mdat', 'free', 'uuid', 'abcd'][1 + l_partkey % 6] AS k FROM lineitem) GROUP BY l_orderkey),
    w AS (SELECT file, h, CAST(0 AS BIGINT) AS p, len(h) // 2 AS size, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS e, '' AS type, 0 AS head, 0 AS n FROM f
      UNION ALL SELECT file, h, p + b, size, p, least(size, p + b), kind, head2, n + 1 FROM (
        SELECT *, CASE WHEN short = 1 THEN 16 ELSE 8 END AS head2, CASE WHEN short = 1 THEN CAST('0x' || h[2 * p + 17:2 * p + 32] AS BIGINT) WHEN short = 0 THEN size - p ELSE short END AS b, decode(unhex(h[2 * p + 9:2 * p + 16])) AS kind
        FROM (SELECT *, CAST('0x' || h[2 * p + 1:2 * p + 8] AS BIGINT) AS short FROM w WHERE p + 8 <= size AND n < 2000)) WHERE b >= head2)
    SELECT file, s, e, type, CAST(head AS INT) AS head FROM w WHERE n > 0""",
)
def box_walk(spark, sf_dir):
    """Each order as a file of ISO media with a box a line, held in pieces of 20 bytes."""
    names = F.array(*map(F.lit, ("ftyp", "moov", "mdat", "free", "uuid", "abcd")))
    n, kind = F.col("l_quantity").cast("int"), F.hex(F.get(names, (F.col("l_partkey") % 6).cast("int")))
    number = lambda c, digits: F.lpad(F.hex(c.cast("long")), digits, "0")
    head = F.when(F.col("l_partkey") % 9 == 0, F.concat(F.lit("00000001"), kind, number(n + 16, 16))).when(F.col("l_partkey") % 41 == 0, F.concat(number(F.col("l_partkey") % 8, 8), kind)).otherwise(F.concat(number(n + 8, 8), kind))
    rows = T(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.unhex(F.concat(head, F.repeat(F.lit("00"), n))).alias("b"))
    files = rows.groupBy("l_orderkey").agg(F.expr("listagg(b) WITHIN GROUP (ORDER BY l_linenumber, l_partkey, l_quantity)").alias("content")).withColumn("size", F.octet_length("content"))
    pieces = F.transform(F.sequence(F.lit(0), F.col("size") - 1, F.lit(20)), lambda s: F.struct(s.cast("long").alias("s"), F.substring(F.col("content"), s + 1, F.lit(20)).alias("bytes")))
    return files.select(F.col("l_orderkey").alias("file"), F.explode(top_boxes(pieces, F.col("size"))["boxes"]).alias("b")).select("file", "b.s", "b.e", "b.type", "b.head")


PARTS_SQL = "SELECT l_orderkey AS file, CAST(l_partkey % 500 - 20 AS BIGINT) AS s, CAST(l_partkey % 500 - 20 + l_quantity * 3 AS BIGINT) AS e, CAST(450 AS BIGINT) AS size FROM lineitem"


def _parts(spark, sf_dir):
    s = F.col("l_partkey") % 500 - 20
    return T(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), s.cast("long").alias("s"), (s + F.col("l_quantity") * 3).cast("long").alias("e"), F.lit(450).cast("long").alias("size"))


@query(
    "r12_merge_parts",
    f"""WITH p AS ({PARTS_SQL}), c AS (SELECT file, greatest(s, 0) AS s, least(e, size) AS e FROM p), k AS (SELECT DISTINCT * FROM c WHERE e > s),
    w AS (SELECT *, max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k),
    i AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM w)
    SELECT file, min(s) AS s, max(e) AS e FROM i GROUP BY file, island""",
)
def merge_parts(spark, sf_dir):
    return R.merge_parts(_parts(spark, sf_dir), "file", size="size")


@query("r12_merge_spread", SQL["r12_merge_parts"])
def merge_spread(spark, sf_dir):
    return R.merge_spread(_parts(spark, sf_dir), "file", size="size")


@query(
    "s12_ranges",
    """SELECT CAST(doc_id % 32 AS INT) AS bucket, CAST(ceil(sum(octet_length(encode(text)) + 1) / 4096.0) AS BIGINT) AS n_ranges, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS n_bytes,
    sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS content_sha256 FROM documents GROUP BY doc_id % 32""",
)
def file_ranges(spark, sf_dir):
    """Files of documents' texts, read by ranges of 4 KiB and put together again."""
    base = scratch(spark, "ranged")
    rows = T(spark, sf_dir, "documents").select((F.col("doc_id") % 32).cast("int").alias("bucket"), "doc_id", "text").repartition("bucket").sortWithinPartitions("bucket", "doc_id")
    rows.select("bucket", "text").write.partitionBy("bucket").text(base)
    cut = ranges.cut(ranges.sizes(spark, base), 4096)
    parts = ranges.read(cut).withColumn("bucket", F.regexp_extract("path", r"/bucket=(\d+)/", 1).cast("int"))
    counts = parts.groupBy("bucket").agg(F.count("*").alias("n_ranges"), F.sum(F.octet_length("bytes")).cast("long").alias("n_bytes"))
    return counts.join(ranges.together(parts, "bucket"), "bucket").select("bucket", "n_ranges", "n_bytes", F.sha2("content", 256).alias("content_sha256"))


@query(
    "r13_read_ratio",
    f"""WITH m AS ({SQL["r12_merge_parts"]}) SELECT file, CAST(sum(e - s) AS BIGINT) AS bytes_read, round(sum(e - s) / 450.0, 6) AS ratio FROM m GROUP BY file""",
)
def read_ratio(spark, sf_dir):
    merged = R.merge_parts(_parts(spark, sf_dir), "file", size="size")
    read = merged.groupBy("file").agg(F.sum(F.col("e") - F.col("s")).alias("bytes_read"))
    return read.select("file", "bytes_read", F.round(F.col("bytes_read") / 450.0, 6).alias("ratio"))


@query("s07_data_urls", "SELECT item_id, text AS decoded FROM benchmark")
def data_urls(spark, sf_dir):
    b = T(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("text", "UTF-8"))).alias("url"))
    return b.select("item_id", F.decode(N.data_url_bytes("url"), "UTF-8").alias("decoded"))


@query(
    "s15_menu_target",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN 'src' || event_id WHEN user_id % 3 = 0 THEN 'link' || event_id WHEN user_id % 3 = 1 THEN 'frame' || event_id ELSE 'page' || event_id END AS target FROM events""",
)
def menu_target(spark, sf_dir):
    e, u, i = T(spark, sf_dir, "events"), F.col("user_id") % 3, F.col("event_id").cast("string")
    name = lambda x: F.concat(F.lit(x), i)
    out = R.menu_target(F.when(F.col("event_type") == "click", "image"), name("src"), F.when(u == 0, name("link")), F.when(u == 1, name("frame")), name("page"))
    return e.select("event_id", out.alias("target"))


@query("s17_document_probe", "SELECT p_partkey, p_partkey % 4 IN (0, 2, 3) AS shows FROM part")
def document_probe(spark, sf_dir):
    mimes = F.array(*map(F.lit, ("image/png", "image/svg+xml", "application/pdf", "video/mp4")))
    return T(spark, sf_dir, "part").select("p_partkey", R.shows_panel(F.get(mimes, (F.col("p_partkey") % 4).cast("int"))).alias("shows"))


@query(
    "s18_detect_mime",
    """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'image/png' WHEN user_id % 3 = 1 AND event_type = 'view' THEN 'text/html' WHEN event_id % 2 = 0 THEN 'guess' END AS mime FROM events""",
)
def detect_mime(spark, sf_dir):
    u = F.col("user_id") % 3
    url = F.concat(F.lit("https://x.example/a"), F.when(F.col("event_id") % 2 == 0, ".PDF?x=1").otherwise(".html"))
    out = R.detected_mime(F.when(u == 0, "image/png"), F.when((u == 1) & (F.col("event_type") == "view"), "text/html"), url)
    return T(spark, sf_dir, "events").select("event_id", out.alias("mime"))


@query("s19_store_prune", "SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def store_prune(spark, sf_dir):
    e = T(spark, sf_dir, "events")
    return unexpired(e, "ts", e.agg(F.max("ts")).first()[0]).select("event_id", "user_id")


# --- sinks


@query(
    "k01_json",
    """SELECT doc_id, '{' || chr(10) || '  "doc_id" : ' || doc_id || ',' || chr(10) || '  "lang" : "' || lang || '",' || chr(10) || '  "size" : {' || chr(10) || '    "n_chars" : ' || n_chars || chr(10) || '  }' || chr(10) || '}' AS report FROM documents""",
)
def json_report(spark, sf_dir):
    d = T(spark, sf_dir, "documents").withColumn("size", F.struct("n_chars"))
    return d.select("doc_id", render.as_json("doc_id", "lang", "size").alias("report"))


@query(
    "k02_escape_html",
    """SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped FROM documents""",
)
def escape_html(spark, sf_dir):
    return T(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(N.escape_html("text"), "UTF-8")).alias("escaped"))


_CHIPS = " || ".join(f"""CASE WHEN {_hit(i)} THEN '<span class="flag" style="color:{render.COLORS[RULES[i][1]]};border-color:{render.COLORS[RULES[i][1]]}">{RULES[i][2]}</span>' ELSE '' END""" for i in range(len(RULES)))
_SIZE = "CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', floor(n_chars / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(n_chars / 1048576.0 * 10 + 0.5) / 10) END"
_P = [f"'{x}'" for x in render.PAGE]


@query(
    "k02_html_report",
    f"""SELECT doc_id AS item_seq, md5(concat({_P[0]}, 'doc-', doc_id, {_P[1]}, 'doc-', doc_id, {_P[2]}, 'Text', {_P[3]}, {_SIZE}, {_P[4]}, {_CHIPS}, {_P[5]},
      CASE WHEN doc_id % 7 = 0 THEN '<p><b>GPS:</b> ' || (doc_id % 90) || ', ' || (doc_id % 180) || '</p>' ELSE '' END,
      '<h2>File</h2><table><tr><td>Size</td><td>', n_chars, '</td></tr><tr><td>Source</td><td>', source, '</td></tr></table>', {_P[6]}, 'now', {_P[7]})) AS page FROM documents""",
)
def html_report(spark, sf_dir):
    return as_reports(spark, sf_dir).select("item_seq", F.md5(F.encode(render.as_html(F.lit("now")), "UTF-8")).alias("page"))


GPS_SQL = "CASE WHEN doc_id % 7 = 0 THEN 'GPS: ' || (doc_id % 90) || ', ' || (doc_id % 180) END"


@query(
    "k03_text_report",
    f"""SELECT doc_id AS item_seq, array_to_string(list_filter(list_concat(['doc-' || doc_id || ' — Text'],
      list_filter([{", ".join(f"CASE WHEN {_hit(i)} THEN '[{RULES[i][1]}] {RULES[i][2]}' END" for i in range(len(RULES)))}], lambda x: x IS NOT NULL),
      [{GPS_SQL}], ['', '## File', 'Size: ' || n_chars, 'Source: ' || source]), lambda x: x IS NOT NULL), chr(10)) AS report FROM documents""",
)
def text_report(spark, sf_dir):
    return as_reports(spark, sf_dir).select("item_seq", render.as_text().alias("report"))


@query(
    "k04_csv_lines",
    f"""SELECT CAST(-1 AS BIGINT) AS seq, chr(65279) || '"url","type","size","gps_lat","gps_lon","warnings","highlights","error"' AS line
    UNION ALL SELECT doc_id, concat('"https://x.example/', doc_id, '","Text","', n_chars, '","', CASE WHEN doc_id % 7 = 0 THEN CAST(doc_id % 90 AS VARCHAR) ELSE '' END, '","',
      CASE WHEN doc_id % 7 = 0 THEN CAST(doc_id % 180 AS VARCHAR) ELSE '' END, '","', array_to_string({FLAG_TEXTS}, ' | '), '","', source, '","', CASE WHEN doc_id % 11 = 0 THEN 'HTTP 404' ELSE '' END, '"') FROM documents""",
)
def csv_lines(spark, sf_dir):
    return render.csv_lines(as_reports(spark, sf_dir))


@query(
    "k04_exact_file",
    f"""WITH f AS (SELECT encode(string_agg(line, chr(13) || chr(10) ORDER BY seq)) AS b FROM ({SQL["k04_csv_lines"]}))
    SELECT CAST(s AS BIGINT) AS s, CAST(octet_length(piece) AS BIGINT) AS n_bytes, sha256(piece) AS piece_sha256
    FROM (SELECT r.s, array_slice(b, r.s + 1, r.s + 4096) AS piece FROM f, unnest(range(0, octet_length(b), 4096)) AS r(s))""",
)
def exact_file(spark, sf_dir):
    """The export as one file, which tasks write together and read again by ranges of 4 KiB."""
    base = scratch(spark, "exact")
    scheme, at = folder(spark, base)
    saved.write_exact(render.csv_lines(as_reports(spark, sf_dir)), f"{scheme}:{at}/scan.csv", ["seq"])
    parts = ranges.read(ranges.cut(ranges.sizes(spark, base), 4096))
    return parts.select("s", F.octet_length("bytes").cast("long").alias("n_bytes"), F.sha2("bytes", 256).alias("piece_sha256"))


@query(
    "k05_base_name",
    r"""SELECT p_partkey, CASE WHEN b = '' THEN 'file' ELSE substr(b, 1, 80) END AS base, (CASE WHEN b = '' THEN 'file' ELSE substr(b, 1, 80) END) || '-clean.' || coalesce(nullif(regexp_extract(n, '\.([A-Za-z0-9]{1,8})$', 1), ''), 'bin') AS clean
    FROM (SELECT p_partkey, n, regexp_replace(regexp_replace(n, '[\\/:*?"<>|]+', '_', 'g'), '\.[^.]+$', '') AS b
      FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || '/x:?.jpg' WHEN 1 THEN p_name ELSE '.pdf' END AS n FROM part))""",
)
def base_names(spark, sf_dir):
    k = F.col("p_partkey") % 3
    p = T(spark, sf_dir, "part").withColumn("n", F.when(k == 0, F.concat("p_name", F.lit("/x:?.jpg"))).when(k == 1, F.col("p_name")).otherwise(F.lit(".pdf")))
    return p.select("p_partkey", N.base_name("n").alias("base"), N.clean_name("n").alias("clean"))


@query(
    "k06_saved_files",
    r"""WITH n AS (SELECT p_partkey, replace(p_brand, '#', CASE WHEN p_size % 5 = 0 THEN ' (' || p_size || ')' ELSE ' ' END) || '-clean.jpg' AS name, p_name || ' ' || p_type AS content FROM part),
    c AS (SELECT *, regexp_extract(name, '(?s)^(.*?)(?: \((\d{1,9})\))?(\.[^.]*)?\z', ['stem', 'number', 'ext']) AS x FROM n),
    w AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) AS nth, row_number() OVER (PARTITION BY x.stem, x.ext ORDER BY name, p_partkey) - 1 AS place,
      greatest(max(TRY_CAST(x.number AS INT)) OVER (PARTITION BY x.stem, x.ext), 1) AS most FROM c)
    SELECT CASE WHEN nth = 1 THEN name ELSE x.stem || ' (' || (most + place) || ')' || x.ext END AS name, CAST(octet_length(encode(content)) AS BIGINT) AS n_bytes, sha256(content) AS content_sha256 FROM w""",
)
def saved_files(spark, sf_dir):
    """Each part as a file under the name of its brand, numbered apart, and read back."""
    mark = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit(" ("), F.col("p_size").cast("string"), F.lit(")"))).otherwise(" ")
    p = T(spark, sf_dir, "part").select("p_partkey", N.clean_name(F.concat(F.replace("p_brand", F.lit("#"), mark), F.lit(".jpg"))).alias("name"), F.concat_ws(" ", "p_name", "p_type").alias("bytes"))
    base = scratch(spark, "saved")
    read = saved.read_files(saved.write_files(p, base, order=["p_partkey"]), base)
    return read.select("name", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("content_sha256"))


@query(
    "k07_badge",
    f"""SELECT doc_id, (CASE doc_id % 4 WHEN 0 THEN 'IMG' WHEN 1 THEN 'PDF' WHEN 2 THEN 'VID' ELSE 'SES' END) || CASE WHEN {_hit(0)} OR {_hit(1)} OR {_hit(2)} THEN '!' ELSE '' END AS text,
      CASE WHEN {_hit(0)} THEN 'red' WHEN {_hit(1)} OR {_hit(2)} THEN 'orange' ELSE 'green' END AS color FROM documents""",
)
def badges(spark, sf_dir):
    mimes = F.array(*map(F.lit, ("image/png", "application/pdf", "video/mp4", "audio/mpeg")))
    b = N.badge(F.get(mimes, (F.col("doc_id") % 4).cast("int")), F.col("flags"))
    return flagged(spark, sf_dir).select("doc_id", b.alias("b")).select("doc_id", "b.text", "b.color")


@query(
    "k09_flag_chips",
    f"""WITH c AS (SELECT doc_id, list_filter([{", ".join(f"CASE WHEN {_hit(i)} THEN '{RULES[i][2]}' END" for i in range(3))}], lambda x: x IS NOT NULL) AS t FROM documents)
    SELECT doc_id, array_to_string(list_concat(t[1:1], CASE WHEN len(t) > 1 THEN ['+' || (len(t) - 1)] ELSE [] END), ' ') AS chips FROM c""",
)
def flag_chips(spark, sf_dir):
    return flagged(spark, sf_dir).select("doc_id", F.array_join(N.flag_chips("flags", 1, ("danger", "warn")), " ").alias("chips"))


@query(
    "k10_pill_summary",
    f"""WITH n AS (SELECT doc_id, source, CAST({_hit(0)} AS INT) + CAST({_hit(1)} AS INT) + CAST({_hit(2)} AS INT) AS n FROM documents)
    SELECT doc_id AS item_seq, 'Text' || CASE WHEN n > 0 THEN ' · ⚠ ' || n ELSE '' END || ' · ' || source AS pill FROM n""",
)
def pill_summary(spark, sf_dir):
    return as_reports(spark, sf_dir).select("item_seq", N.pill_summary("info", "flags", "highlights", "sections").alias("pill"))


# --- detection and predicates

#: Heads of files by number, and their types. Fixed values.
HEADS = (("ffd8ffe0", "jpeg"), ("89504e470d0a1a0a", "png"), ("474946383961", "gif"), ("524946460000000057454250", "webp"), ("524946460000000057415645", "wav"), ("524946460000000041564920", "avi"), ("49492a00", "tiff"), ("00000018667479706d696631", "heif"), ("00000018667479704d344120", "m4a"), ("00000018667479707174202000", "mov"), ("000000186674797069736f6d", "mp4"), ("000000206d6f6f76", "mov"), ("664c6143", "flac"), ("4944330300000000000000", "mp3"), ("4f676753", "ogg"), ("1a45dfa3", "mkv"), ("504b0304", "zip"), ("d0cf11e0", "ole"), ("20255044462d312e37", "pdf"), ("3c73766720", "svg"), ("00000100010000", "ico"), ("fffb9064", "mp3"), ("68656c6c6f", None), ("fff0", None))


@query(
    "t01_sniff",
    "SELECT o_orderkey, CASE o_orderkey % 24 " + " ".join(f"WHEN {i} THEN '{k}'" for i, (_, k) in enumerate(HEADS) if k) + " END AS type FROM orders",
)
def sniff(spark, sf_dir):
    heads = F.array(*[F.unhex(F.lit(h)) for h, _ in HEADS])
    o = T(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.get(heads, (F.col("o_orderkey") % 24).cast("int")), F.encode(F.lit(" some text, no more"), "UTF-8")).alias("content"))
    return o.select("o_orderkey", N.sniff("content").alias("type"))


MIMES = ("image/jpeg", "image/PNG; q=1", "application/pdf", "video/mp4", "text/html; charset=utf-8", "application/octet-stream", "")
KINDS_OF = ("jpeg", "png", "pdf", "mp4", None)


@query(
    "t02_type_table",
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'JPEG' WHEN 1 THEN 'PNG' WHEN 2 THEN 'PDF' WHEN 3 THEN 'MP4' ELSE 'Unknown' END AS label, CASE p_partkey % 5 WHEN 2 THEN 'pdf' WHEN 3 THEN 'media' WHEN 4 THEN NULL ELSE 'image' END AS category, p_partkey % 5 < 4 AS strippable, p_partkey % 5 < 2 AS reencodable FROM part",
)
def type_table(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, KINDS_OF)), (F.col("p_partkey") % 5).cast("int"))
    p = T(spark, sf_dir, "part").withColumn("type", kind)
    return p.select("p_partkey", N.type_label("type").alias("label"), N.category_of("type").alias("category"), F.coalesce(N.strippable("type"), F.lit(False)).alias("strippable"), F.coalesce(N.can_reencode("type"), F.lit(False)).alias("reencodable"))


@query(
    "t03_mime",
    """WITH m AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'video/mp4' WHEN 4 THEN 'text/html' WHEN 5 THEN 'application/octet-stream' ELSE '' END AS mime,
      CASE o_orderkey % 5 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'pdf' WHEN 3 THEN 'mp4' END AS type FROM orders),
    c AS (SELECT *, CASE WHEN mime LIKE 'image/%' THEN 'image' WHEN mime = 'application/pdf' THEN 'pdf' WHEN mime LIKE 'video/%' THEN 'media' WHEN mime LIKE 'text/html%' THEN 'html' END AS category FROM m)
    SELECT o_orderkey, mime, category, CASE WHEN type IS NULL OR category IS NULL THEN false
      ELSE category <> CASE type WHEN 'pdf' THEN 'pdf' WHEN 'mp4' THEN 'media' ELSE 'image' END OR (type IN ('jpeg', 'png') AND mime <> 'image/' || type) END AS mismatch FROM c""",
)
def mime(spark, sf_dir):
    o = T(spark, sf_dir, "orders").select("o_orderkey", N.normal_mime(F.get(F.array(*map(F.lit, MIMES)), (F.col("o_orderkey") % 7).cast("int"))).alias("mime"), F.get(F.array(*map(F.lit, KINDS_OF)), (F.col("o_orderkey") % 5).cast("int")).alias("type"))
    return o.select("o_orderkey", "mime", N.mime_category("mime").alias("category"), N.mime_mismatch("type", "mime").alias("mismatch"))


@query(
    "t06_name_from_url",
    r"""WITH p AS (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '^\w+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages)
    SELECT page_id, CASE WHEN len(parts) > 0 THEN parts[len(parts)] ELSE regexp_extract(url, '^\w+://([^/?#:]*)', 1) END AS name FROM p""",
)
def names(spark, sf_dir):
    return T(spark, sf_dir, "pages").select("page_id", N.name_from_url("url").alias("name"))


@query("t08_findings", f"SELECT doc_id FROM documents WHERE {_hit(0)} OR {_hit(1)} OR {_hit(2)}")
def findings(spark, sf_dir):
    return R.findings_only(flagged(spark, sf_dir)).select("doc_id")


@query(
    "t09_field_search",
    "SELECT doc_id AS file_id, lang AS v FROM documents WHERE contains(lower(translate(text, 'Iİ', 'ıi')), lower(translate('IN ', 'Iİ', 'ıi')))",
)
def field_search(spark, sf_dir):
    rows = T(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("lang").alias("k"), F.col("text").alias("v"), F.lit("").alias("section_title"))
    return R.field_search(rows, "IN ").select("file_id", F.col("k").alias("v"))


@query("t09_indexed_search", SQL["t09_field_search"].replace("'IN '", "'Inst'"))
def indexed_search(spark, sf_dir):
    """The same by an index of trigrams, made here."""
    path = f"{scratch(spark, 'index')}/postings"
    rows = T(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("lang").alias("k"), F.col("text").alias("v"), F.lit("").alias("section_title"))
    search.write_index(rows, "file_id", path)
    return search.indexed_search(rows, "file_id", path, "Inst").select("file_id", F.col("k").alias("v"))


@query("t10_predicates", "SELECT c_custkey, c_custkey % 5 IN (0, 1) AS sensitive, c_custkey % 4 IN (0, 3) AS executable, c_custkey % 3 = 1 AS retriable FROM customer")
def predicates(spark, sf_dir):
    from ..operators.extract.pdf import EXECUTABLE
    from ..operators.extraction import SENSITIVE_HEADER

    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (F.col("c_custkey") % len(xs)).cast("int"))
    return T(spark, sf_dir, "customer").select("c_custkey", pick(("Server", "X-Amz-Id", "content-length", "date", "etag")).rlike(f"(?i){SENSITIVE_HEADER.pattern}").alias("sensitive"), pick(("a.EXE", "b.txt", "c.pdf", "d.docm")).rlike(f"(?i){EXECUTABLE.pattern}").alias("executable"), N.retriable(pick((404, 403, 500))).alias("retriable"))


@query("t12_printable", "SELECT doc_id, length(regexp_replace(substr(t, 1, 64), '[^\\x20-\\x7e]', '', 'g')) > 0.8 * least(64, length(t)) AS printable FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN repeat(chr(1), 20) ELSE '' END || regexp_replace(text, '[^\\x00-\\x7f]', '', 'g') AS t FROM documents) WHERE length(t) > 0")
def printable(spark, sf_dir):
    t = F.concat(F.when(F.col("doc_id") % 2 == 0, F.repeat(F.char(F.lit(1)), F.lit(20))).otherwise(""), F.regexp_replace("text", "[^\\x00-\\x7f]", ""))
    return T(spark, sf_dir, "documents").select("doc_id", t.alias("t")).where("length(t) > 0").select("doc_id", N.printable(F.encode("t", "ISO-8859-1")).alias("printable"))


# --- extraction that SQL can follow


@query(
    "e08_svg_report",
    r"""SELECT CAST(item_id AS VARCHAR) AS file_id, 'SVG' AS type_label, '10 × 20' AS size, trim(text) AS title, CAST(item_id % 3 AS VARCHAR) AS scripts, item_id % 3 > 0 AS danger FROM benchmark""",
)
def svg_report(spark, sf_dir):
    b = T(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("file_id"), F.encode(F.concat(F.lit('<svg width="10" height="20"><title>'), N.escape_html("text"), F.lit("</title>"), F.repeat(F.lit("<script>1</script>"), (F.col("item_id") % 3).cast("int")), F.lit("</svg>")), "UTF-8").alias("content"))
    r = extract(b)
    rows = F.flatten(F.transform("sections", lambda s: s["rows"]))
    value = lambda k: F.get(F.filter(rows, lambda x: x["k"] == k), F.lit(0))["v"]
    return r.select("file_id", "info.type_label", value("width × height").alias("size"), value("title").alias("title"), F.coalesce(value("<script> tags"), F.lit("0")).alias("scripts"), F.exists("flags", lambda f: f["level"] == "danger").alias("danger"))


@query("c05_svg_clean", "SELECT item_id, '<svg><title>' || text || '</title></svg>' AS cleaned FROM benchmark")
def svg_clean(spark, sf_dir):
    b = T(spark, sf_dir, "benchmark")
    s = F.concat(F.lit('<svg inkscape:version="1"><metadata>\nx</metadata><!-- made\nby --><title>'), F.col("text"), F.lit('</title><sodipodi:namedview a="b"/></svg>'))
    return b.select("item_id", svg_text(s).alias("cleaned"))


@query(
    "e09q_paper",
    """SELECT p_partkey, CASE WHEN (abs(w - 595) < 4 AND abs(h - 842) < 4) OR (abs(w - 842) < 4 AND abs(h - 595) < 4) THEN 'A4' WHEN (abs(w - 612) < 4 AND abs(h - 792) < 4) OR (abs(w - 792) < 4 AND abs(h - 612) < 4) THEN 'Letter' END AS paper
    FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 590 + p_size WHEN 1 THEN 840 + p_size % 7 ELSE 612 END AS w, CASE p_partkey % 3 WHEN 0 THEN 842 WHEN 1 THEN 595 ELSE 792 END AS h FROM part)""",
)
def paper(spark, sf_dir):
    k = F.col("p_partkey") % 3
    p = T(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, 590 + F.col("p_size")).when(k == 1, 840 + F.col("p_size") % 7).otherwise(612).alias("w"), F.when(k == 0, 842).when(k == 1, 595).otherwise(792).alias("h"))
    return R.nearest_paper(p, "w", "h", list(PAPER)).select("p_partkey", "paper")


@query(
    "e09q_sizes",
    """WITH p AS (SELECT p_partkey, 20 + p_partkey % 977 AS w, 20 + (p_partkey * 7 + p_size) % 991 AS h FROM part),
    s AS (SELECT DISTINCT ps_w AS w, ps_h AS h, min(k) AS ordinal FROM (SELECT p_partkey AS k, 20 + (p_partkey * 13) % 977 AS ps_w, 20 + (p_partkey * 11) % 991 AS ps_h FROM part) GROUP BY 1, 2),
    m AS (SELECT p.p_partkey, s.ordinal, row_number() OVER (PARTITION BY p.p_partkey ORDER BY s.ordinal) AS n FROM p JOIN s ON (abs(p.w - s.w) < 4 AND abs(p.h - s.h) < 4) OR (abs(p.w - s.h) < 4 AND abs(p.h - s.w) < 4))
    SELECT p.p_partkey, 'size ' || m.ordinal AS paper FROM p LEFT JOIN m ON m.p_partkey = p.p_partkey AND m.n = 1""",
)
def paper_sizes(spark, sf_dir):
    """The first near size of as many as there are parts."""
    k = F.col("p_partkey")
    part = T(spark, sf_dir, "part")
    p = part.select("p_partkey", (20 + k % 977).alias("w"), (20 + (k * 7 + F.col("p_size")) % 991).alias("h"))
    sizes = part.select((20 + (k * 13) % 977).alias("w"), (20 + (k * 11) % 991).alias("h"), k.alias("ordinal")).groupBy("w", "h").agg(F.min("ordinal").alias("ordinal"))
    return R.nearest_size(p, "w", "h", sizes.withColumn("name", F.concat(F.lit("size "), F.col("ordinal").cast("string")))).select("p_partkey", "paper")


@query("e14_id3v1", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN substr(p_name, 1, 30) END AS title, CASE WHEN p_partkey % 2 = 0 THEN CAST(1 + p_partkey % 200 AS INT) END AS track FROM part")
def id3v1(spark, sf_dir):
    pad = lambda c, n: F.substring(F.concat(F.encode(c, "ISO-8859-1"), F.unhex(F.lit("00" * n))), 1, n)
    tag = F.concat(F.encode(F.when(F.col("p_partkey") % 2 == 0, "TAG").otherwise("GAT"), "ISO-8859-1"), pad(F.substring("p_name", 1, 30), 30), F.unhex(F.lit("00" * 93)), F.unhex(F.lpad(F.hex(1 + F.col("p_partkey") % 200), 2, "0")), F.unhex(F.lit("00")))
    return T(spark, sf_dir, "part").select("p_partkey", N.id3v1(F.concat(F.unhex(F.lit("ff" * 40)), tag)).alias("x")).select("p_partkey", "x.title", "x.track")


@query(
    "r15_flatten",
    "SELECT doc_id AS file_id, CAST(0 AS INT) AS row_ord, 'Size' AS k, CAST(n_chars AS VARCHAR) AS v FROM documents UNION ALL SELECT doc_id, 1, 'Source', source FROM documents",
)
def flatten(spark, sf_dir):
    return metadata_rows(as_reports(spark, sf_dir).withColumn("file_id", F.col("item_seq"))).select("file_id", "row_ord", "k", "v")


# --- relational


@query("r02_severity", f"SELECT doc_id, CAST({SEVERITY} AS INT) AS severity FROM documents")
def severity(spark, sf_dir):
    return flagged(spark, sf_dir).select("doc_id", N.severity("flags").alias("severity"))


@query(
    "r03_rank",
    f"SELECT doc_id, severity, row_number() OVER (ORDER BY severity DESC, doc_id) AS place FROM (SELECT doc_id, CAST({SEVERITY} AS INT) AS severity FROM documents) ORDER BY 3 LIMIT 100",
)
def rank(spark, sf_dir):
    top = R.ranked(flagged(spark, sf_dir), "doc_id").limit(100)
    from pyspark.sql import Window

    return top.select("doc_id", "severity", F.row_number().over(Window.orderBy(F.desc("severity"), "doc_id")).cast("long").alias("place"))


def _scan_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items of a scan: some have failed, some are pending."""
    k = F.col("item_seq")
    r = as_reports(spark, sf_dir)
    return r.withColumn("flags", F.when((k % 11 != 0) & (k % 13 != 5), F.col("flags"))).withColumn("gps", F.when((k % 11 != 0) & (k % 13 != 5), F.col("gps"))).withColumn("error", F.when(k % 13 != 5, F.col("error")))


_OPEN = "(doc_id % 11 <> 0 AND doc_id % 13 <> 5)"


@query(
    "r05_scan_summary",
    f"""SELECT count_if(doc_id % 13 <> 5) AS done, count(*) AS total, count_if({_OPEN} AND doc_id % 7 = 0) AS gps, count_if({_OPEN} AND {_hit(1)}) AS names, count_if({_OPEN} AND {_hit(2)}) AS active, count_if(doc_id % 11 = 0 AND doc_id % 13 <> 5) AS errors FROM documents""",
)
def scan_summary(spark, sf_dir):
    return R.scan_summary(_scan_state(spark, sf_dir))


@query("r06_multi_file_summary", f"SELECT count(*) AS total, count_if(doc_id % 13 <> 5) AS analysed, count_if({_OPEN} AND doc_id % 7 = 0) AS gps FROM documents")
def multi_file_summary(spark, sf_dir):
    return R.multi_file_summary(_scan_state(spark, sf_dir))


@query(
    "r07_first_wins",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1",
)
def first_wins(spark, sf_dir):
    return R.first_wins(T(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(
    "r08_last_wins",
    """SELECT user_id, arg_max(event_type, struct_pack(ts, event_id)) AS last_type, arg_max(event_id, struct_pack(ts, event_id)) FILTER (WHERE event_type = 'purchase') AS last_purchase FROM events GROUP BY user_id""",
)
def last_values(spark, sf_dir):
    e = T(spark, sf_dir, "events").withColumn("last_type", F.col("event_type")).withColumn("last_purchase", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return R.last_values(e, ["user_id"], ["ts", "event_id"], ["last_type", "last_purchase"])


@query(
    "r09_histogram",
    "SELECT source, string_agg(lang || CASE WHEN n > 1 THEN '×' || n ELSE '' END, ', ' ORDER BY first) AS text FROM (SELECT source, lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1, 2) GROUP BY source",
)
def histogram(spark, sf_dir):
    return R.histogram_text(T(spark, sf_dir, "documents"), "source", "lang", "doc_id")


KEYWORDS = ("token", "password", "JavaScript", "license", "the", "der")


@query(
    "r10_keywords",
    "SELECT CAST(ordinal AS INT) AS ordinal, keyword, n FROM ("
    + " UNION ALL ".join(f"SELECT {i} AS ordinal, '{k}' AS keyword, CAST(sum(len(regexp_extract_all(text, '(?:^|[^0-9A-Za-z_])(?:{k})(?:$|[^0-9A-Za-z_])'))) AS BIGINT) AS n FROM (SELECT regexp_replace(text, '([^0-9A-Za-z_])', '\\1\\1', 'g') AS text FROM documents)" for i, k in enumerate(KEYWORDS))
    + ") WHERE n > 0",
)
def keywords(spark, sf_dir):
    return R.keyword_counts(T(spark, sf_dir, "documents"), "text", list(KEYWORDS))


@query("r14_embedded_union", "SELECT p_partkey AS file_id, 'File' AS section_title, p_name AS v FROM part UNION ALL SELECT ps, 'Embedded file · ' || b, t FROM (SELECT p_size AS ps, p_brand AS b, p_type AS t FROM part)")
def embedded_union(spark, sf_dir):
    p = T(spark, sf_dir, "part")
    rows = lambda id, v, *more: p.select(id, F.lit("file").alias("section_id"), F.lit("File").alias("section_title"), F.lit("k").alias("k"), F.col(v).alias("v"), F.lit(False).alias("s"), *more)
    out = R.embedded_union(rows(F.col("p_partkey").alias("file_id"), "p_name"), rows(F.col("p_size").cast("long").alias("parent_id"), "p_type", F.col("p_brand").alias("label")))
    return out.select("file_id", "section_title", "v")


@query(
    "r16_largest",
    "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size * (p_partkey % 10) DESC, p_partkey) AS n FROM part) WHERE n = 1",
)
def largest(spark, sf_dir):
    p = T(spark, sf_dir, "part").withColumn("w", F.col("p_partkey") % 10)
    return R.largest(p, ["p_brand"], "p_size", "w", "p_partkey", ["p_partkey"])


@query("r17_sorted_headers", "SELECT c_custkey, 'a=' || c_mktsegment || ';b=' || c_name || ';c=' || c_nationkey AS headers FROM customer")
def sorted_headers(spark, sf_dir):
    m = F.create_map(F.lit("c"), F.col("c_nationkey").cast("string"), F.lit("a"), F.col("c_mktsegment"), F.lit("b"), F.col("c_name"))
    return T(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.transform(R.sorted_headers(m), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("headers"))


@query(
    "r18_verified",
    f"""WITH b AS (SELECT doc_id, source, unnest([{", ".join(f"CASE WHEN {_hit(i)} THEN '{RULES[i][0]}' END" for i in range(3))}]) AS code FROM documents)
    SELECT doc_id AS file_id, code, NOT (code = 'email' OR source = 'src0') AS removed FROM b WHERE code IS NOT NULL""",
)
def verified(spark, sf_dir):
    d = flagged(spark, sf_dir).withColumn("file_id", F.col("doc_id"))
    after = d.withColumn("flags", F.filter("flags", lambda f: (f["code"] == "email") | (F.col("source") == "src0")))
    return R.verified(d, after)


EXACT = {"en": "English", "de": "German", "fr": "French"}


@query(
    "r19_translate",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(w, lang) WHEN doc_id % 3 = 1 THEN doc_id || ' pages' ELSE coalesce(w, lang) || ' · ' || source || ', ' || coalesce(w, lang) END AS said
    FROM (SELECT doc_id, lang, source, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' END AS w FROM documents)""",
)
def translate(spark, sf_dir):
    k = F.col("doc_id") % 3
    said = F.when(k == 0, F.col("lang")).when(k == 1, F.concat(F.col("doc_id").cast("string"), F.lit(" sayfa"))).otherwise(F.concat(F.col("lang"), F.lit(" · "), F.col("source"), F.lit(", "), F.col("lang")))
    return T(spark, sf_dir, "documents").select("doc_id", R.translated(said, EXACT, [(r"^(\d+) sayfa$", "$1 pages")]).alias("said"))


@query(
    "r19_dictionary",
    r"""WITH x AS (SELECT l_orderkey, l_linenumber, w, CASE l_linenumber % 6 WHEN 0 THEN w WHEN 1 THEN u WHEN 2 THEN w || ' · q, ' || w WHEN 3 THEN '✓ ' || w || ', ' || u || ', other' WHEN 4 THEN 'a · b, ' || u ELSE 'none, here' END AS text
      FROM (SELECT l_orderkey, l_linenumber, p_name || ' ' || p_brand AS w, CAST(l_quantity AS INT) || ' adet Supplier#' || printf('%09d', l_suppkey) AS u FROM lineitem JOIN part ON p_partkey = l_partkey)),
    e AS (SELECT p_name || ' ' || p_brand AS rest, arg_min(p_type || ' (' || p_partkey || ')', p_partkey) AS target FROM part GROUP BY 1),
    l AS (SELECT * FROM (VALUES (0, ''), (1, ' · '), (2, '  '), (3, ', '), (4, ' | '), (5, chr(10))) AS l(level, sep)),
    p AS (SELECT text, level, sep, parts, unnest(range(1, len(parts) + 1)) AS place FROM (SELECT text, level, sep, CASE WHEN level = 0 THEN [text] ELSE string_split(text, sep) END AS parts FROM (SELECT DISTINCT text FROM x), l WHERE level = 0 OR contains(text, sep))),
    m AS (SELECT *, CASE WHEN level > 0 AND parts[place][1:2] IN ('✓ ', '✗ ') THEN parts[place][1:2] ELSE '' END AS mark, parts[place][len(mark) + 1:] AS rest, regexp_extract(rest, '^([0-9]+) adet (Supplier#[0-9]+)$', ['n', 's']) AS g FROM p),
    k AS (SELECT text, level, sep, place, mark, rest, coalesce(target, s_name || ': ' || g.n || ' pieces') AS said FROM m LEFT JOIN e USING (rest) LEFT JOIN supplier ON s_name = g.s),
    b AS (SELECT text, level, string_agg(CASE WHEN place > 1 THEN sep ELSE '' END || mark || coalesce(said, rest), '' ORDER BY place) AS joined FROM k GROUP BY text, level HAVING count(said) > 0)
    SELECT l_orderkey, l_linenumber, coalesce(said, text) AS said FROM x LEFT JOIN (SELECT text, arg_min(joined, level) AS said FROM b GROUP BY text) USING (text)""",
)
def dictionary_tables(spark, sf_dir):
    """Lines named by a dictionary of all parts and a pattern for each supplier."""
    parts = T(spark, sf_dir, "part").withColumn("w", F.concat_ws(" ", "p_name", "p_brand"))
    unit = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" adet Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))
    lines = T(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", unit.alias("u")).join(parts.select(F.col("p_partkey").alias("l_partkey"), "w"), "l_partkey")
    k = F.col("l_linenumber") % 6
    forms = {0: ["w"], 1: ["u"], 2: ["w", F.lit(" · q, "), "w"], 3: [F.lit("✓ "), "w", F.lit(", "), "u", F.lit(", other")], 4: [F.lit("a · b, "), "u"]}
    text = F.lit("none, here")
    for n, made in forms.items():
        text = F.when(k == n, F.concat(*made)).otherwise(text)
    exact = parts.select(F.col("p_partkey").alias("ordinal"), F.col("w").alias("source"), F.concat("p_type", F.lit(" ("), F.col("p_partkey").cast("string"), F.lit(")")).alias("target"))
    patterns = T(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ordinal"), F.concat(F.lit("^([0-9]+) adet "), "s_name", F.lit("$")).alias("pattern"), F.concat("s_name", F.lit(": $1 pieces")).alias("template"))
    return dictionary.translate(lines.select("l_orderkey", "l_linenumber", text.alias("text")), "text", exact, patterns).drop("text")


@query(
    "f23_language",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_nationkey % 3 = 0 THEN 'tr' ELSE 'en' END WHEN 1 THEN 'tr' WHEN 2 THEN 'de' ELSE 'en' END AS lang,
      CASE WHEN c_custkey % 2 = 0 THEN 'Name of ' || upper(c_mktsegment) ELSE c_name END AS said FROM customer""",
)
def shown_language(spark, sf_dir):
    pick = lambda xs, k: F.get(F.array(*map(F.lit, xs)), (F.col(k) % len(xs)).cast("int"))
    lang = R.language(pick(("auto", "tr", "de", "xx"), "c_custkey"), pick(("tr-TR", "en-US", "fr"), "c_nationkey"), ["en", "de"])
    said = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Ad: "), "c_mktsegment")).otherwise(F.col("c_name"))
    own = R.translated(said, {"Ad": "Name"}, [("^Ad: ", lambda c: F.concat(F.lit("Name of "), F.upper(F.substring(c, 5, 100))))])
    return T(spark, sf_dir, "customer").select("c_custkey", lang.alias("lang"), own.alias("said"))


@query("f23_fill", "SELECT c_custkey, c_name || ' of ' || c_mktsegment || ' (' || c_name || ')' AS said FROM customer")
def fill(spark, sf_dir):
    v = F.array("c_name", "c_mktsegment", "c_name")
    return T(spark, sf_dir, "customer").select("c_custkey", R.filled(F.lit("{} of {1} ({0})"), v).alias("said"))


@query(
    "r20_bits",
    "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size & 4 > 0 THEN 'Print' END, CASE WHEN p_size & 8 > 0 THEN 'Modify' END, CASE WHEN p_size & 16 > 0 THEN 'Copy' END], lambda x: x IS NOT NULL), ', ') AS allowed FROM part",
)
def bits(spark, sf_dir):
    return T(spark, sf_dir, "part").select("p_partkey", F.array_join(N.bit_names("p_size", [(4, "Print"), (8, "Modify"), (16, "Copy")]), ", ").alias("allowed"))


EVENT_SQL = "SELECT event_id, user_id AS tab_id, ts, 'https://x.example/' || (event_id % 3) AS url, CASE event_type WHEN 'click' THEN 'image/png' WHEN 'view' THEN 'text/html' ELSE 'video/mp4' END AS mime, event_id % 10 = 0 AS closed FROM events"


def _tab_events(spark, sf_dir, events=None):
    e = T(spark, sf_dir, "events") if events is None else events
    mime = F.when(F.col("event_type") == "click", "image/png").when(F.col("event_type") == "view", "text/html").otherwise("video/mp4")
    return e.select("event_id", F.col("user_id").alias("tab_id"), "ts", F.concat(F.lit("https://x.example/"), (F.col("event_id") % 3).cast("string")).alias("url"), mime.alias("mime"), (F.col("event_id") % 10 == 0).alias("closed"))


@query(
    "w01_tab_state",
    f"SELECT tab_id, url, mime FROM (SELECT *, row_number() OVER (PARTITION BY tab_id ORDER BY ts DESC, event_id DESC) AS n FROM ({EVENT_SQL})) WHERE n = 1 AND NOT closed AND mime <> 'text/html'",
)
def tabs(spark, sf_dir):
    e = _tab_events(spark, sf_dir).withColumn("at", F.struct("ts", "event_id"))
    return tab_state(e, "at")


def _in_time(df: DataFrame, batches: int = 4) -> list[DataFrame]:
    """A table of events in so many parts of equal time, in order."""
    first, last = df.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        return [df]
    step = (last - first) / batches
    return [df.where((F.col("ts") >= first + k * step if k else F.lit(True)) & (F.col("ts") < first + (k + 1) * step if k < batches - 1 else F.lit(True))) for k in range(batches)]


@query("w01_tab_state_stream", SQL["w01_tab_state"])
def tabs_stream(spark, sf_dir):
    """Tabs by keyed state, over four batches."""
    events = _tab_events(spark, sf_dir)
    return tabs_now(changes_of(_in_time(events), lambda stream: tab_changes(stream, is_media("mime"))))


@query(
    "w03_expired",
    """SELECT key, item, make_timestamp(1000 * (epoch_us(ts) // 1000)) AS saved_at FROM (
      SELECT user_id AS key, event_id AS item, ts, epoch_us(ts) // 1000 AS put_at, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS next_at, (SELECT max(epoch_us(ts) // 1000) FROM events) AS last_at FROM events
    ) WHERE coalesce(next_at, last_at - 1000) - put_at > 3600000""",
)
def expired_puts(spark, sf_dir):
    """Each user's last event is held for an hour; those whose hour passes without another go out, over four batches."""
    puts = T(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("item"), "ts")
    out = changes_of(_in_time(puts), lambda stream: expired(stream, datetime.timedelta(hours=1), "ts"), "append")
    return out.select("key", "item", F.col("saved_at").cast("timestamp_ntz").alias("saved_at"))


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream. The path is a pattern, since a stream's may not be a single file."""
    return spark.readStream.schema(T(spark, sf_dir, name).schema).parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]")


@query("w02_badge_stream", SQL["k07_badge"].replace("SELECT doc_id,", "SELECT doc_id AS tab_id,", 1))
def badge_stream(spark, sf_dir):
    mimes = F.array(*map(F.lit, ("image/png", "application/pdf", "video/mp4", "audio/mpeg")))
    results = flagged(spark, sf_dir, _stream(spark, sf_dir, "documents"))
    return run_to_table(badges_of(results.select(F.col("doc_id").alias("tab_id"), F.get(mimes, (F.col("doc_id") % 4).cast("int")).alias("mime"), "flags")), "append")


@query("w04_progressive", SQL["r03_rank"].replace("doc_id, severity,", "doc_id AS item_seq, severity,", 1))
def progressive_ranks(spark, sf_dir):
    """Ranks of results that come in four batches, as the last one shows them; its summary has to count all."""
    base = scratch(spark, "progress")

    def show(rows: DataFrame, summary: DataFrame, number: int) -> None:
        rows.select("item_seq", "severity").limit(100).write.mode("overwrite").parquet(f"{base}/rows")
        summary.write.mode("overwrite").parquet(f"{base}/summary")

    documents = T(spark, sf_dir, "documents")
    parts = [documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == k) for k in range(4)]
    run_in_batches(parts, lambda stream, checkpoint: progressive(as_reports(spark, sf_dir, stream), show, checkpoint, most=100).awaitTermination())
    from pyspark.sql import Window

    ranks = spark.read.parquet(f"{base}/rows").withColumn("place", F.row_number().over(Window.orderBy(F.desc("severity"), "item_seq")).cast("long"))  # 100 rows
    counted = spark.read.parquet(f"{base}/summary").first()
    return ranks.where(F.lit(counted["total"] == documents.count()))


@query("s16_media_events", f"SELECT event_id, mime FROM ({EVENT_SQL}) WHERE mime <> 'text/html'")
def media_events(spark, sf_dir):
    return _tab_events(spark, sf_dir).where(is_media("mime")).select("event_id", "mime")


@query("s16_media_stream", SQL["s16_media_events"])
def media_stream(spark, sf_dir):
    """The same from a log of events: four epochs, each read by a start from the checkpoint; the last start finds nothing new."""
    base = scratch(spark, "log")
    out = f"{base}/media"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    for part in [*_in_time(_tab_events(spark, sf_dir)), None]:
        if part is not None:
            log.append(part.select("event_id", "mime"), f"{base}/log")
        events = log.stream(spark, f"{base}/log").select(F.from_json("line", "event_id long, mime string").alias("x")).select("x.event_id", "x.mime")
        events.where(is_media("mime")).writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, mime string").parquet(out).select("event_id", "mime")


@query(
    "r22_page_state",
    f"WITH s AS ({SQL['w01_tab_state']}) SELECT e.event_id, e.tab_id, s.mime FROM ({EVENT_SQL}) e LEFT JOIN s ON e.tab_id = s.tab_id AND e.url = s.url",
)
def page_state(spark, sf_dir):
    return R.tab_of(_tab_events(spark, sf_dir).drop("mime"), tabs(spark, sf_dir)).select("event_id", "tab_id", "mime")


# --- scalar functions


@query(
    "f02_pdf_date",
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' +03:30' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' ELSE 'soon' END AS at FROM orders",
)
def pdf_dates(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    s = F.when(k == 0, F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("+03'30'"))).when(k == 1, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.lit("soon"))
    return T(spark, sf_dir, "orders").select("o_orderkey", N.pdf_date(s).alias("at"))


@query(
    "f03_dates",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' UTC' AS mac, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' UTC' AS ebml FROM orders""",
)
def dates(spark, sf_dir):
    t = F.unix_timestamp("o_orderdate")
    return T(spark, sf_dir, "orders").select("o_orderkey", N.stamp(N.mac_date(t + 2082844800)).alias("mac"), N.stamp(N.ebml_date((t - 978307200) * 1000000000)).alias("ebml"))


@query(
    "f05_iso6709",
    "SELECT s_suppkey, CAST(s_suppkey % 90 AS DOUBLE) + 0.5 AS lat, -(CAST(s_suppkey % 180 AS DOUBLE) + 0.25) AS lon, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS DOUBLE) END AS alt FROM supplier",
)
def positions(spark, sf_dir):
    k = F.col("s_suppkey")
    s = F.concat(F.lit("+"), (k % 90).cast("string"), F.lit(".5-"), (k % 180).cast("string"), F.lit(".25"), F.when(k % 2 == 0, F.concat(F.lit("+"), k.cast("string"))).otherwise(""), F.lit("/"))
    return T(spark, sf_dir, "supplier").select("s_suppkey", N.iso6709(s).alias("p")).select("s_suppkey", "p.lat", "p.lon", "p.alt")


@query(
    "f06_language",
    "SELECT p_partkey, chr(CAST(97 + p_partkey % 26 AS INT)) || chr(CAST(97 + p_size % 26 AS INT)) || 'x' AS lang FROM part",
)
def languages(spark, sf_dir):
    code = (F.col("p_partkey") % 26 + 1) * 1024 + (F.col("p_size") % 26 + 1) * 32 + 24
    return T(spark, sf_dir, "part").select("p_partkey", N.packed_language(code.cast("int")).alias("lang"))


@query("f07_synchsafe", "SELECT o_orderkey, CAST(o_orderkey % 268435456 AS INT) AS n FROM orders")
def synchsafe(spark, sf_dir):
    k = F.col("o_orderkey") % 268435456
    byte = lambda s: F.unhex(F.lpad(F.hex(F.shiftright(k, s).bitwiseAND(F.lit(127))), 2, "0"))
    return T(spark, sf_dir, "orders").select("o_orderkey", N.synchsafe(F.concat(byte(21), byte(14), byte(7), byte(0)), 0).alias("n"))


@query(
    "f08_mpeg_header",
    "SELECT p_partkey, CAST([32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320][1 + p_partkey % 14] AS INT) AS kbps, CAST(44100 AS INT) AS hz, CAST(1152 AS INT) AS samples FROM part",
)
def mpeg_headers(spark, sf_dir):
    third = F.unhex(F.concat(F.lower(F.hex(F.col("p_partkey") % 14 + 1)), F.lit("0")))
    h = F.concat(F.unhex(F.lit("fffb")), third, F.unhex(F.lit("64")))
    return T(spark, sf_dir, "part").select("p_partkey", N.mpeg_header(h).alias("x")).select("p_partkey", "x.kbps", "x.hz", "x.samples")


@query("f10_digests", "SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5 FROM documents")
def digests(spark, sf_dir):
    b = F.encode("text", "UTF-8")
    return T(spark, sf_dir, "documents").select("doc_id", F.sha2(b, 256).alias("sha256"), F.sha1(b).alias("sha1"), F.md5(b).alias("md5"))


@query("f01_pdf_text", "SELECT item_id, text AS a, text AS b FROM benchmark")
def pdf_texts(spark, sf_dir):
    a = F.concat(F.unhex(F.lit("feff")), F.encode("text", "UTF-16BE"), F.unhex(F.lit("0000")))
    b = F.concat(F.unhex(F.lit("efbbbf")), F.encode("text", "UTF-8"))
    return T(spark, sf_dir, "benchmark").select("item_id", N.pdf_text(a).alias("a"), N.pdf_text(b).alias("b"))


@query("f16_csv_quote", """SELECT doc_id, md5('"' || replace(text, '"', '""') || '"') AS quoted FROM documents""")
def csv_quotes(spark, sf_dir):
    return T(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(N.csv_quote("text"), "UTF-8")).alias("quoted"))


@query(
    "f19_conversions",
    """SELECT p_partkey, CAST(floor(p_size * 100 * 0.0254::DOUBLE + 0.5) AS BIGINT) AS dpi, CAST(floor(p_size * 0.3528::DOUBLE + 0.5) AS BIGINT) AS mm, printf('%.1f', p_size * 4000 * 1000 / 1000000.0) AS megapixels, CAST(floor(p_size * 0.7::DOUBLE + 0.5) AS BIGINT) AS half_up FROM part""",
)
def conversions(spark, sf_dir):
    s = F.col("p_size")
    return T(spark, sf_dir, "part").select("p_partkey", N.dpi_from_metre(s * 100).alias("dpi"), N.points_to_mm(s).alias("mm"), N.megapixels(s * 4000, F.lit(1000)).alias("megapixels"), N.half_up(s * 0.7).alias("half_up"))


@query(
    "f21_texts",
    "SELECT p_partkey, p_name || ' Bold' AS font, 'hex' AS hex, '<a x=\"Author\"></a>' AS renamed, '<r></r>' AS removed FROM part",
)
def texts(spark, sf_dir):
    return T(spark, sf_dir, "part").select(
        "p_partkey",
        N.font_name(F.concat(F.lit("ABCDEF+"), "p_name", F.lit("#20Bold"))).alias("font"),
        F.decode(N.from_hex(F.lit("686578")), "UTF-8").alias("hex"),
        N.replace_attributes(F.concat(F.lit('<a x="'), "p_brand", F.lit('"></a>')), ["x", "y"], "Author").alias("renamed"),
        N.remove_elements(F.concat(F.lit("<r><d.c a='1'>"), "p_brand", F.lit("</d.c><e:f/></r>")), ["d.c", "e:f"]).alias("removed"),
    )


@query(
    "f26_formats",
    """SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(n / 1048576.0 * 10 + 0.5) / 10) END AS size,
      CASE WHEN n >= 3600 THEN (n // 3600) || ':' || lpad(CAST(n // 60 % 60 AS VARCHAR), 2, '0') ELSE CAST(n // 60 AS VARCHAR) END || ':' || lpad(CAST(n % 60 AS VARCHAR), 2, '0') || CASE WHEN n % 2 = 1 THEN '.50' ELSE '' END AS duration
    FROM (SELECT o_orderkey, CAST(o_orderkey * 37 % 3000000 AS BIGINT) AS n FROM orders)""",
)
def formats(spark, sf_dir):
    n = F.col("o_orderkey") * 37 % 3000000
    return T(spark, sf_dir, "orders").select("o_orderkey", N.size_text(n).alias("size"), N.duration_text(n + F.when(n % 2 == 1, 0.5).otherwise(0.0)).alias("duration"))


# --- plans


@query(
    "scan_ranked",
    f"""WITH d AS (SELECT doc_id, source, CAST({SEVERITY} AS INT) AS severity FROM documents), s AS (SELECT * FROM d WHERE severity >= 10)
    SELECT source, count(*) AS files, max(severity) AS worst, CAST(sum(severity) AS BIGINT) AS total, min(doc_id) AS first FROM s GROUP BY source""",
)
def scan_ranked(spark, sf_dir):
    d = flagged(spark, sf_dir).select("doc_id", "source", N.severity("flags").alias("severity"))
    # Conditions inside the aggregates: a filter would be pushed below the projection and rate every text twice.
    own = lambda c: F.when(F.col("severity") >= 10, F.col(c))
    out = d.groupBy("source").agg(F.count(own("severity")).alias("files"), F.max(own("severity")).alias("worst"), F.sum(own("severity")).cast("long").alias("total"), F.min(own("doc_id")).alias("first"))
    return out.where("files > 0")
