"""Relational operators over files, flags, parts and page items, as DataFrame expressions.

Order is data here (first wins, last wins, input order), so each operator takes the columns that order rows.
Grouped answers combine before their shuffle; a hot key costs each map task one row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import native
from ..sources.shared import checkpointed

PERSON = "(?i)author|last-modified|last-saved|owner"
ACTIVE = "(?i)JavaScript|macro|executable|script"


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in order. An aggregation, so no key's rows meet in one task before they are combined."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("fg_first"))
    return best.select(*keys, *[F.col(f"fg_first.{c}").alias(c) for c in rest]).select(*df.columns)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last in order."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("fg_last"))
    return best.select(*keys, *[F.col(f"fg_last.{c}").alias(c) for c in rest]).select(*df.columns)


def last_values(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """For each key, each column's last value that isn't null."""
    place = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns])


def capped(df: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each key; Spark limits each map task's rows before the shuffle."""
    place = "fg_n"
    while place.lower() in map(str.lower, df.columns):
        place += "_"
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(place, F.row_number().over(w)).where(F.col(place) <= most).drop(place)


def ranked(reports: DataFrame, seq: str = "item_seq") -> DataFrame:
    """Reports by descending severity; ties, errors and pending ones last in input order."""
    return reports.withColumn("severity", native.severity("flags")).orderBy(F.desc("severity"), F.asc(seq))


def findings_only(reports: DataFrame) -> DataFrame:
    return reports.where(native.has_findings("flags"))


def _any_text(pattern: str) -> Column:
    return F.coalesce(F.exists("flags", lambda f: f["text"].rlike(pattern)), F.lit(False))


def scan_summary(state: DataFrame) -> DataFrame:
    """done, total, and files with a position, a person's name, active content, an error. state: flags, gps, error."""
    done = F.col("flags").isNotNull() | F.col("error").isNotNull()
    return state.agg(F.count_if(done).alias("done"), F.count("*").alias("total"), F.count_if(F.col("gps").isNotNull()).alias("gps"), F.count_if(_any_text(PERSON)).alias("names"), F.count_if(_any_text(ACTIVE)).alias("active"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def multi_file_summary(state: DataFrame) -> DataFrame:
    return state.agg(F.count("*").alias("total"), F.count_if(F.col("flags").isNotNull() | F.col("error").isNotNull()).alias("analysed"), F.count_if(F.col("gps").isNotNull()).alias("gps"))


def merge_parts(parts: DataFrame, key: str, s: str = "s", e: str = "e", size: str | None = None) -> DataFrame:
    """Disjoint intervals of each key, touching and overlapping ones joined; clamped to [0, size], empty ones dropped."""
    low = F.greatest(F.col(s), F.lit(0))
    high = F.least(F.col(e), F.col(size)) if size else F.col(e)
    rows = parts.select(key, low.cast("long").alias("s"), high.cast("long").alias("e")).where("e > s")
    w = Window.partitionBy(key).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("s") <= F.col("fg_reach"), 0).otherwise(1)).over(w)
    return rows.withColumn("fg_reach", reach).withColumn("fg_island", island).groupBy(key, "fg_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("fg_island")


def merge_spread(parts: DataFrame, key: str, s: str = "s", e: str = "e", size: str | None = None) -> DataFrame:
    """merge_parts for keys with any number of parts: a key's parts are spread over tasks by their place, each task merges its own, and what reaches over from earlier tasks comes from one row for each key and task."""
    low = F.greatest(F.col(s), F.lit(0))
    high = F.least(F.col(e), F.col(size)) if size else F.col(e)
    rows = parts.select(F.col(key).alias("k"), low.cast("long").alias("s"), high.cast("long").alias("e")).where("e > s")
    # A checkpoint, so that a row's task is the same for all that follows.
    rows = checkpointed(rows.repartitionByRange("k", "s").withColumn("task", F.spark_partition_id()))
    own = Window.partitionBy("k", "task").orderBy("s", "e")
    before = Window.partitionBy("k").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    beside = lambda left, right: left.join(right.toDF("of_k", "of_task", "known"), F.col("k").eqNullSafe(F.col("of_k")) & (F.col("task") == F.col("of_task"))).drop("of_k", "of_task")
    carried = rows.groupBy("k", "task").agg(F.max("e").alias("most")).select("k", "task", F.max("most").over(before))
    reached = beside(rows, carried).withColumn("reach", F.greatest(F.max("e").over(own.rowsBetween(Window.unboundedPreceding, -1)), "known")).drop("known")
    marked = reached.withColumn("starts", F.when(F.col("reach").isNull() | (F.col("s") > F.col("reach")), F.col("s")))
    begun = marked.groupBy("k", "task").agg(F.max("starts").alias("last")).select("k", "task", F.max("last").over(before))
    # Over rows up to here and their equals: of equal rows only one is marked.
    placed = beside(marked, begun).withColumn("start", F.coalesce(F.max("starts").over(own), "known"))
    return placed.groupBy("k", "start").agg(F.max("e").alias("e")).select(F.col("k").alias(key), F.col("start").alias("s"), "e")


def bytes_read(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + p["e"] - p["s"])


def histogram_text(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, text: a×2, b in the order in which values first occur."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    item = F.struct("first", F.concat(F.col(value), F.when(F.col("n") > 1, F.concat(F.lit("×"), F.col("n").cast("string"))).otherwise("")).alias("t"))
    return counts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ", ").alias("text"))


def keyword_counts(df: DataFrame, text: str, keywords: list[str]) -> DataFrame:
    """ordinal, keyword, n over all texts, for the keywords of a fixed list that occur as names (/keyword or word)."""
    sums = df.agg(*[F.sum(F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(rf"\b{k}\b"))).alias(f"k{i}") for i, k in enumerate(keywords)])
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(k).alias("keyword"), F.col(f"k{i}").cast("long").alias("n")) for i, k in enumerate(keywords)])
    return sums.select(F.inline(rows)).where("n > 0").orderBy("ordinal")


def nearest_paper(df: DataFrame, width: str, height: str, papers: list[tuple[str, int, int]], within: int = 4) -> DataFrame:
    """df with paper: the first of a short list whose sides are both nearer than within points, in either orientation."""
    near = lambda a, b: F.abs(F.col(width) - a) < within
    out = F.lit(None).cast("string")
    for name, a, b in reversed(papers):
        upright = near(a, b) & (F.abs(F.col(height) - b) < within)
        turned = near(b, a) & (F.abs(F.col(height) - a) < within)
        out = F.when(upright | turned, name).otherwise(out)
    return df.withColumn("paper", out)


def nearest_size(df: DataFrame, width: str, height: str, sizes: DataFrame, within: int = 4) -> DataFrame:
    """df with paper: of a table of sizes (ordinal, name, w, h) the first whose sides are both nearer than within, in either orientation; null if none is.

    Sizes stand in the nine cells of a grid around them, so pairs meet by equality; each pair of sides of df is looked up once.
    """
    cell = lambda c: F.floor(F.col(c) / within).cast("long")
    turned = sizes.select("ordinal", "name", F.col("w").alias("a"), F.col("h").alias("b")).unionByName(sizes.select("ordinal", "name", F.col("h").alias("a"), F.col("w").alias("b")))
    near = F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long"))
    keyed = turned.withColumns({"x": cell("a"), "y": cell("b")}).withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).select("ordinal", "name", "a", "b", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
    asked = df.select(F.col(width).alias("w"), F.col(height).alias("h")).distinct().withColumns({"x": cell("w"), "y": cell("h")})
    met = asked.join(keyed, ["x", "y"]).where((F.abs(F.col("w") - F.col("a")) < within) & (F.abs(F.col("h") - F.col("b")) < within))
    best = met.groupBy("w", "h").agg(F.min_by("name", "ordinal").alias("paper")).toDF("fg_w", "fg_h", "paper")
    return df.join(best, (F.col(width) == F.col("fg_w")) & (F.col(height) == F.col("fg_h")), "left").drop("fg_w", "fg_h")


def largest(df: DataFrame, keys: list[str], width: str, height: str, order: str, columns: list[str]) -> DataFrame:
    """For each key the row of the largest area; of equal ones the first."""
    best = F.max_by(F.struct(*columns), F.struct((F.col(width) * F.col(height)).alias("area"), (-F.col(order)).alias("o")))
    return df.groupBy(*keys).agg(best.alias("fg_best")).select(*keys, *[F.col(f"fg_best.{c}").alias(c) for c in columns])


def sorted_headers(headers) -> Column:
    return F.array_sort(F.map_entries(headers))


def verified(before: DataFrame, after: DataFrame) -> DataFrame:
    """file_id, code, removed for each flag of the first extraction that isn't info: is it gone from the second?"""
    one = lambda df: df.select("file_id", F.explode("flags").alias("f")).where("f.level <> 'info'").select("file_id", F.col("f.code").alias("code")).distinct()
    left, right = one(before), one(after).withColumn("there", F.lit(True))
    return left.join(right, ["file_id", "code"], "left").select("file_id", "code", F.col("there").isNull().alias("removed"))


def embedded_union(parents: DataFrame, children: DataFrame, parent: str = "parent_id", label: str = "label") -> DataFrame:
    """Long rows of parents, and of embedded files under their parent and label."""
    own = parents.select("file_id", "section_id", "section_title", "k", "v", "s", F.lit(None).cast("string").alias("embedded"))
    other = children.select(F.col(parent).alias("file_id"), "section_id", F.concat(F.lit("Embedded file · "), F.col(label)).alias("section_title"), "k", "v", "s", F.col(label).alias("embedded"))
    return own.unionByName(other)


def folded(c: Column) -> Column:
    """Lower case by Turkish rules: I -> ı, İ -> i."""
    return F.lower(F.translate(c, "Iİ", "ıi"))


def field_search(rows: DataFrame, query: str) -> DataFrame:
    """Long rows whose key, value or section title contains the query, in lower case by Turkish rules."""
    q = folded(F.lit(query))
    return rows.where(F.contains(folded(F.col("k")), q) | F.contains(folded(F.col("v")), q) | F.contains(folded(F.col("section_title")), q))


SEPARATORS = r"( · | — | / |: |, )"


def translated(text, exact: dict[str, str], patterns: list[tuple[str, str | Callable[[Column], Column]]]) -> Column:
    """A dictionary look-up: the whole text, else the first pattern that matches, else its parts between separators, else unchanged.

    A pattern's value is a replacement, or a function of the text.
    """
    c = F.col(text) if isinstance(text, str) else text
    words = F.create_map(*[F.lit(x) for kv in exact.items() for x in kv]) if exact else None
    known = words[c] if words is not None else F.lit(None).cast("string")
    value = lambda p: p[1](c) if callable(p[1]) else F.regexp_replace(c, p[0], p[1])
    by_pattern = reduce(lambda rest, p: F.when(c.rlike(p[0]), value(p)).otherwise(rest), reversed(patterns), F.lit(None).cast("string"))
    parts = F.split(F.regexp_replace(c, SEPARATORS, "\x01$1\x01"), "\x01")
    joined = F.array_join(F.transform(parts, lambda x: F.coalesce(words[x], x) if words is not None else x), "")
    return F.coalesce(known, by_pattern, F.when(c.rlike(SEPARATORS), joined), c)


def language(preference, ui_language, known: list[str], source: str = "tr", fallback: str = "en") -> Column:
    """The language to show: what is preferred, if there is a dictionary for it or it is the texts' own; else by the surface's language."""
    detected = F.when(F.coalesce(ui_language, F.lit("")).rlike(rf"(?i)^{source}\b"), source).otherwise(fallback)
    return F.when(preference.isNull() | (preference == "auto") | (preference == ""), detected).when(preference.isin(source, *known), preference).otherwise(fallback)


def filled(template, values) -> Column:
    """A template's {} in order, or {0} by place; null is empty."""
    v = values
    by_place = F.aggregate(F.sequence(F.lit(0), F.size(v) - 1), template, lambda t, k: F.replace(t, F.concat(F.lit("{"), k.cast("string"), F.lit("}")), F.coalesce(F.get(v, k), F.lit(""))))
    pieces = F.split(by_place, r"\{\}")
    return F.array_join(F.transform(pieces, lambda p, k: F.when(k == 0, p).otherwise(F.concat(F.coalesce(F.get(v, k - 1), F.lit("")), p))), "")


def tab_of(tabs: DataFrame, state: DataFrame) -> DataFrame:
    """Tabs with the MIME type of their state, where both id and URL are equal."""
    return tabs.join(state.select("tab_id", "url", "mime"), ["tab_id", "url"], "left")


def detected_mime(state_mime, document_type, url) -> Column:
    """The tab state's type, else the document's, else 'guess' by the extension."""
    known = r"(?i)\.(pdf|jpe?g|png|gif|webp|tiff?|heic|avif|svg|bmp|mp3|mp4|mov|m4a|flac|wav|ogg|webm|mkv)(\?|#|$)"
    return F.coalesce(state_mime, document_type, F.when(url.rlike(known), F.lit("guess")))


def menu_target(media_type, src_url, link_url, frame_url, page_url) -> Column:
    """Source that a context menu selects."""
    return F.when(media_type.isin("image", "video", "audio"), src_url).otherwise(F.coalesce(link_url, frame_url, page_url))


def shows_panel(mime, top_frame=None, auto_panel=None) -> Column:
    """Does a document of this type show the panel by itself?"""
    yes = mime.rlike(r"^image/(?!svg)|^application/(x-)?pdf$|^(video|audio)/")
    for more in (top_frame, auto_panel):
        yes = yes if more is None else yes & more
    return yes
