"""Items of web pages: images, media, links to files and backgrounds, found in HTML by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import capped, first_wins

#: Extensions of links that are scanned. Fixed values.
LINKED = r"(?i)\.(pdf|jpe?g|png|gif|webp|tiff?|heic|heif|avif|svg|docx?|docm|xlsx?|xlsm|pptx?|odt|ods|odp|epub|msg|mp3|m4a|flac|ogg|opus|wav|mp4|mov|m4v|mkv|webm|avi)$"
KINDS = ("img", "media", "link", "bg")
FRAME_LIMIT, SCAN_LIMIT, URL_LIMIT, SMALL = 200, 150, 4096, 48
#: The rest of a tag after its name; a > in quotes does not end it.
TAIL = r"""\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
ENTITIES = (("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def tags(html: Column, names: str) -> Column:
    """The tags of these names (a|b), in order."""
    return F.regexp_extract_all(html, F.lit(f"(?i)<(?:{names}){TAIL}"), F.lit(0))


def unescaped(value: Column) -> Column:
    for name, char in ENTITIES:
        value = F.replace(value, F.lit(name), F.lit(char))
    return value


def attribute(tag: Column, name: str) -> Column:
    """A tag's attribute, quoted or not, without entities; empty without one."""
    found = F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*("[^"]*+"|'[^']*+'|[^\s"'>]++)""", 1)
    return F.trim(unescaped(F.regexp_replace(found, "^[\"']|[\"']$", "")))


def with_absolute(df: DataFrame, base: str, ref: str, out: str) -> DataFrame:
    """df with out: a reference resolved against a URL: absolute, host-relative, or relative to its folder, without . and .. segments. Fragments stay.

    A column for each step, so that no step's expression is repeated in the next.
    """
    b, r = F.col(base), F.col(ref)
    df = df.withColumns({"fg_scheme": F.regexp_extract(b, r"^(\w+):", 1), "fg_host": F.regexp_extract(b, r"^(\w+://[^/?#]+)", 1), "fg_page": F.regexp_extract(b, r"^\w+://[^/?#]+([^?#]*)", 1)})
    folder = F.regexp_extract("fg_page", "^(.*/)", 1)
    df = df.withColumn("fg_folder", folder).withColumn("fg_whole", F.when(r.startswith("/"), r).when(r.rlike("^[?#]"), F.concat("fg_page", r)).when(F.col("fg_folder") == "", F.concat(F.lit("/"), r)).otherwise(F.concat("fg_folder", r)))
    df = df.withColumns({"fg_path": F.regexp_extract("fg_whole", r"^([^?#]*)", 1), "fg_rest": F.regexp_extract("fg_whole", r"^[^?#]*(.*)$", 1)})
    parts = F.split(F.regexp_replace("fg_path", r"/\.{1,2}$", "$0/"), "/")
    step = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    kept = F.aggregate(F.slice("fg_parts", F.lit(2), F.size("fg_parts")), F.array().cast("array<string>"), step)
    df = df.withColumn("fg_parts", parts).withColumn("fg_path", F.when(F.contains("fg_path", F.lit("/.")), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(F.col("fg_path")))
    url = F.when(r.rlike(r"^[A-Za-z][\w+.-]*:"), r).when(r.startswith("//"), F.concat("fg_scheme", F.lit(":"), r)).otherwise(F.concat("fg_host", "fg_path", "fg_rest"))
    return df.withColumn(out, url).drop("fg_scheme", "fg_host", "fg_page", "fg_folder", "fg_whole", "fg_path", "fg_rest", "fg_parts")


def _images(html: Column) -> Column:
    size = lambda t, name: F.regexp_extract(attribute(t, name), r"^\d+", 0).try_cast("int")
    found = F.transform(tags(html, "img"), lambda t: F.struct(attribute(t, "src").alias("src"), attribute(t, "srcset").alias("srcset"), size(t, "width").alias("w"), size(t, "height").alias("h")))
    large = F.filter(found, lambda x: large_enough(x["w"], x["h"]))
    return F.transform(large, lambda x: F.when(x["src"] == "", F.regexp_extract(x["srcset"], r"^\s*([^\s,]+)", 1)).otherwise(x["src"]))


def _media(html: Column) -> Column:
    """Sources of players, and those inside them; other <source> tags belong to pictures."""
    players = F.regexp_extract_all(html, F.lit(r"(?is)<(?:video|audio)\b.*?(?=</(?:video|audio)\b|$)"), F.lit(0))
    return F.transform(F.flatten(F.transform(players, lambda p: tags(p, "video|audio|source"))), lambda t: attribute(t, "src"))


def _links(html: Column) -> Column:
    return F.transform(tags(html, "a"), lambda t: attribute(t, "href"))


def _backgrounds(html: Column) -> Column:
    styles = F.regexp_extract_all(html, F.lit(r"""(?i)\sstyle\s*=\s*("[^"]*+"|'[^']*+')"""), F.lit(1))
    drawn = F.filter(styles, lambda x: F.contains(F.lower(x), F.lit("background")))
    value = lambda x: unescaped(F.regexp_replace(x, "^.|.$", ""))
    return F.transform(drawn, lambda x: F.regexp_extract(value(x), r"""(?i)background[^;]*?url\(["']?([^"')]+)["']?\)""", 1))


FINDERS = dict(zip(KINDS, (_images, _media, _links, _backgrounds), strict=True))


def references(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", kinds=KINDS) -> DataFrame:
    """key, kind, ord, ref, url of what pages refer to; kinds in their order, each in the order of the page. A <base> counts."""

    def of(n: int, kind: str) -> Column:
        return F.transform(FINDERS[kind](F.col("html")), lambda r, i: F.struct(F.lit(kind).alias("kind"), (F.lit(n << 40) + i).alias("ord"), r.alias("ref")))

    found = F.flatten(F.array(*[of(KINDS.index(kind), kind) for kind in kinds]))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("page"), F.col(html).alias("html"))
    rows = rows.withColumn("base_ref", attribute(F.get(tags(F.col("html"), "base"), F.lit(0)), "href"))
    rows = with_absolute(rows, "page", "base_ref", "own").withColumn("base", F.when(F.coalesce("base_ref", F.lit("")) == "", F.col("page")).otherwise(F.col("own")))
    rows = rows.select("key", "base", F.explode(F.filter(found, lambda x: x["ref"] != "")).alias("x")).select("key", "base", "x.kind", "x.ord", "x.ref")
    return with_absolute(rows, "base", "ref", "url").select(F.col("key").alias(key), "kind", "ord", "ref", "url")


def scanned(items: DataFrame) -> DataFrame:
    """Items with http(s) or data URLs of bounded length; links only where they lead to a file."""
    path = F.regexp_extract("url", r"^\w+://[^/?#]*([^?#]*)", 1)
    return items.where(F.col("url").rlike("^(https?:|data:)") & (F.length("url") <= URL_LIMIT) & ((F.col("kind") != "link") | path.rlike(LINKED)))


def large_enough(width, height) -> Column:
    """Images below 48 pixels on both sides are left out; unknown sizes stay."""
    small = lambda n: F.coalesce((n > 0) & (n < SMALL), F.lit(False))
    return ~(small(width) & small(height))


def page_items(pages: DataFrame, key: str = "page_id", only_files: bool = True, most: int = FRAME_LIMIT) -> DataFrame:
    """The first items of each page, each URL once, under the kind that comes first."""
    items = references(pages, key)
    items = scanned(items) if only_files else items.where(F.col("url").rlike("^(https?:|data:)") & (F.length("url") <= URL_LIMIT))
    return capped(first_wins(items, [key, "url"], ["ord"]), [key], ["ord"], most)


def union_frames(items: DataFrame, scan: str, frame: str, most: int = SCAN_LIMIT) -> DataFrame:
    """Items of all frames of a scan in the order of frames, each URL once, up to a limit."""
    return capped(first_wins(items, [scan, "url"], [frame, "ord"]), [scan], [frame, "ord"], most)
