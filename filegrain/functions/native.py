"""Scalar functions as Catalyst expressions: they run in generated code, without Python.

Arguments are columns (or names); each returns a column.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.extract.detect import BITRATES, SIGNATURES, RATES, TYPES

# --- types and MIME

GENERIC = "octet-stream|binary|force-download|x-download|unknown"
#: MIME types of each type that are exact. Fixed values.
EXACT = {
    "jpeg": ["image/jpeg", "image/jpg", "image/pjpeg"],
    "png": ["image/png", "image/apng"],
    "gif": ["image/gif"],
    "webp": ["image/webp"],
    "tiff": ["image/tiff"],
    "heif": ["image/heic", "image/heif", "image/heic-sequence", "image/heif-sequence"],
    "avif": ["image/avif"],
    "bmp": ["image/bmp", "image/x-ms-bmp"],
    "svg": ["image/svg+xml"],
    "ico": ["image/x-icon", "image/vnd.microsoft.icon"],
    "pdf": ["application/pdf", "application/x-pdf"],
}
#: Types that can be cleaned, and the extension of the result. Fixed values.
CLEANED = {"jpeg": "jpg", "png": "png", "webp": "webp", "gif": "gif", "svg": "svg", "pdf": "pdf", "mp4": "mp4", "mov": "mov", "m4a": "m4a", "3gp": "3gp", "heif": "heic", "avif": "avif", "mp3": "mp3", "flac": "flac", "wav": "wav", "zip": "zip"}
CATEGORY = (("image", "^image/"), ("pdf", "^application/(x-)?pdf$"), ("media", "^(video|audio)/"), ("html", "^text/html"))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _hex(b: bytes) -> Column:
    return F.unhex(F.lit(b.hex()))


def _mpeg_sync(b: Column) -> Column:
    h = F.conv(F.hex(F.substring(b, 1, 4)), 16, 10).cast("long")
    bits = lambda shift, mask: F.shiftright(h, shift).bitwiseAND(F.lit(mask))
    return (F.length(b) >= 4) & (bits(21, 0x7FF) == 0x7FF) & (bits(19, 3) != 1) & (bits(17, 3) != 0) & ~bits(12, 15).isin(0, 15) & (bits(10, 3) != 3)


def sniff(content) -> Column:
    """Type of a file by its first bytes: the first signature that fits. Only 8 KiB of content are looked at, and what follows an ID3 tag."""
    c = _c(content)
    latin = lambda start, n: F.decode(F.substring(c, start, n), "ISO-8859-1")
    head = latin(F.lit(1), F.lit(8192))
    number = lambda x: F.conv(F.hex(F.encode(x, "ISO-8859-1")), 16, 10).cast("long")
    listed = F.greatest(F.lit(4), F.least(F.lit(64), number(F.substring(head, 1, 4)) - 8)).cast("int")
    tag = sum((number(F.substring(head, 7 + k, 1)) % 128 * 128 ** (3 - k) for k in range(4)), F.lit(0))
    views = {
        "head": head,
        "brands": F.when(F.substring(head, 5, 4) == "ftyp", latin(F.lit(9), listed)),
        "behind": F.when(head.startswith("ID3"), latin((tag + 11).cast("int"), F.lit(4))),
    }
    flags = lambda p: ("(?si)", p[4:]) if p.startswith("(?i)") else ("(?s)", p)
    rule = lambda p: "{}\\A(?:{})".format(*flags(p))
    return F.coalesce(*[F.when(views[view].rlike(rule(pattern)), kind) for kind, view, pattern in SIGNATURES])


def _lookup(kind, values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[_c(kind)]


def type_label(kind) -> Column:
    return F.coalesce(_lookup(kind, {k: v[0] for k, v in TYPES.items()}), F.lit("Unknown"))


def category_of(kind) -> Column:
    return _lookup(kind, {k: v[1] for k, v in TYPES.items()})


def normal_mime(content_type) -> Column:
    return F.lower(F.trim(F.substring_index(_c(content_type), ";", 1)))


def mime_category(mime) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(CATEGORY):
        out = F.when(_c(mime).rlike(pattern), name).otherwise(out)
    return out


def mime_mismatch(kind, mime) -> Column:
    """Does the server's MIME type contradict the detected type?"""
    k, m = _c(kind), _c(mime)
    exact = F.create_map(*[x for t, ms in EXACT.items() for x in (F.lit(t), F.array(*map(F.lit, ms)))])[k]
    unknown = k.isNull() | m.isNull() | (m == "") | m.rlike(GENERIC) | mime_category(m).isNull()
    return F.when(unknown, False).when(~mime_category(m).eqNullSafe(category_of(k)), True).otherwise(F.coalesce(~F.array_contains(exact, m), F.lit(False)))


def mismatch(kind: str | None, mime: str | None, category: str | None) -> bool:
    """mime_mismatch for one file, inside the extraction stage."""
    if not kind or not mime or re.search(GENERIC, mime):
        return False
    own = next((n for n, p in CATEGORY if re.search(p, mime)), None)
    return own is not None and (own != category or (kind in EXACT and mime not in EXACT[kind]))


def strippable(kind) -> Column:
    return _c(kind).isin(list(CLEANED))


def can_reencode(kind, category=None) -> Column:
    """Raster images that a codec could draw again."""
    k = _c(kind)
    return (category_of(k) == "image") & ~k.isin("svg", "ico", "tiff", "heif", "cr3")


def badge_base(mime) -> Column:
    m = _c(mime)
    return F.when(m.rlike("pdf"), "PDF").when(m.rlike("^video/"), "VID").when(m.rlike("^audio/"), "SES").otherwise("IMG")


def printable(content) -> Column:
    """Over 0.8 of the first 64 bytes are printable ASCII."""
    head = F.decode(F.substring(_c(content), 1, 64), "ISO-8859-1")
    return F.length(F.regexp_replace(head, "[^\\x20-\\x7e]", "")) > 0.8 * F.greatest(F.lit(1), F.length(head))


def retriable(status, type_error=None) -> Column:
    return _c(status).isin(401, 403, 407, 451)


# --- names and URLs


def name_from_url(url) -> Column:
    """Last non-empty path segment, decoded; else the host; what isn't a URL: its first 80 characters."""
    u = _c(url)
    path = F.regexp_extract(u, r"^[A-Za-z][\w+.-]*:(?://[^/?#]*)?([^?#]*)", 1)
    host = F.regexp_extract(u, r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    last = F.element_at(parts, F.when(F.size(parts) > 0, F.size(parts)).otherwise(F.lit(1)))
    plain = F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)
    named = F.when(F.size(parts) > 0, plain).otherwise(host)
    return F.when(u.startswith("data:"), "data: URL").when(u.startswith("blob:"), "blob: URL").when(u.rlike("^[A-Za-z][\\w+.-]*:/"), named).otherwise(F.substring(u, 1, 80))


def base_name(name) -> Column:
    """A file name without reserved characters and extension, at most 80 characters."""
    n = F.regexp_replace(F.regexp_replace(F.coalesce(_c(name), F.lit("file")), r'[\\/:*?"<>|]+', "_"), r"\.[^.]+$", "")
    return F.when(n == "", "file").otherwise(F.substring(n, 1, 80))


def clean_name(name, ext=None) -> Column:
    n = _c(name)
    own = F.regexp_extract(n, r"\.([A-Za-z0-9]{1,8})$", 1)
    return F.concat(base_name(n), F.lit("-clean."), F.coalesce(F.nullif(own, F.lit("")), _c(ext) if ext is not None else F.lit(None), F.lit("bin")))


def data_url_bytes(url) -> Column:
    """Bytes of a data: URL; base64 or percent-encoded."""
    u = _c(url)
    body = F.substring_index(u, ",", -1)
    return F.when(u.rlike("^data:[^,]*;base64,"), F.try_to_binary(F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))), F.lit("base64"))).when(u.startswith("data:"), F.try_url_decode(body).cast("binary"))


# --- dates and positions


def pdf_date(s) -> Column:
    """D:YYYYMMDDHHmmSS with zone -> Y-M-D h:m:s zone; what doesn't match stays."""
    c = _c(s)
    pattern = r"^(?:D:)?(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?([Zz+-])?(\d\d)?'?(\d\d)?"
    part = lambda i, fallback: F.coalesce(F.nullif(F.regexp_extract(c, pattern, i), F.lit("")), F.lit(fallback))
    z = F.regexp_extract(c, pattern, 7)
    zone = F.when(z == "", "").when(F.lower(z) == "z", " UTC").otherwise(F.concat(F.lit(" "), z, part(8, "00"), F.lit(":"), part(9, "00")))
    out = F.concat(F.regexp_extract(c, pattern, 1), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit(" "), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"), zone)
    return F.when(c.rlike(pattern), out).otherwise(c)


def stamp(at) -> Column:
    return F.concat(F.date_format(_c(at), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def mac_date(seconds) -> Column:
    """Seconds since 1904; null up to 1970."""
    t = _c(seconds)
    return F.when(t > 2082844800, F.timestamp_seconds(t - 2082844800))


def ebml_date(nanoseconds) -> Column:
    """Signed nanoseconds since 2001."""
    return F.timestamp_micros(F.lit(978307200000000) + F.floor(_c(nanoseconds) / 1000).cast("long"))


def iso6709(s) -> Column:
    """struct lat, lon, alt of a position in decimal degrees; null if it isn't one."""
    c, pattern = F.trim(_c(s)), r"^([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)?"
    number = lambda i: F.nullif(F.regexp_extract(c, pattern, i), F.lit("")).cast("double")
    return F.when(c.rlike(pattern), F.struct(number(1).alias("lat"), number(2).alias("lon"), number(3).alias("alt")))


def packed_language(code) -> Column:
    """Three letters of five bits each; und and what isn't letters: null."""
    c = _c(code)
    letters = F.concat(*[F.char(F.shiftright(c, s).bitwiseAND(F.lit(31)) + 96) for s in (10, 5, 0)])
    return F.when(letters.rlike("^[a-z]{3}$") & (letters != "und"), letters)


# --- numbers


def half_up(x) -> Column:
    return F.floor(_c(x) + F.lit(0.5))


def dpi_from_metre(pixels) -> Column:
    return half_up(_c(pixels) * 0.0254)


def points_to_mm(points) -> Column:
    return half_up(_c(points) * 0.3528)


def megapixels(width, height) -> Column:
    return F.format_string("%.1f", _c(width) * _c(height) / F.lit(1e6))


def size_text(n) -> Column:
    c = _c(n)
    out = F.format_string("%.1f TB", c / 1024.0**4)
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(c < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", c / 1024.0**power)).otherwise(out)
    return F.when(c < 1024, F.concat(c.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def duration_text(seconds) -> Column:
    """0:02, 2:05, 1:33.50, 1:02:03."""
    h = F.floor(_c(seconds) * 100 + 0.5).cast("long")
    s, part = F.floor(h / 100).cast("long"), h % 100
    hours, minutes, secs = F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    whole = F.when(hours > 0, F.concat_ws(":", hours.cast("string"), two(minutes), two(secs))).otherwise(F.concat_ws(":", minutes.cast("string"), two(secs)))
    return F.when(part > 0, F.concat(whole, F.lit("."), two(part))).otherwise(whole)


def synchsafe(content, at: int) -> Column:
    """28 bits in four bytes of seven at a place (from 0)."""
    out = F.lit(0)
    for i in range(4):
        out = F.shiftleft(out, 7) + F.conv(F.hex(F.substring(_c(content), at + i + 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(127))
    return out


def mpeg_header(content, at: int = 0) -> Column:
    """struct version, layer, kbps, hz, mode, samples of a frame header; null where fields are reserved."""
    h = F.conv(F.hex(F.substring(_c(content), at + 1, 4)), 16, 10).cast("long")
    bits = lambda shift, mask: F.shiftright(h, shift).bitwiseAND(F.lit(mask)).cast("int")
    version = F.when(bits(19, 3) == 3, 1.0).when(bits(19, 3) == 2, 2.0).otherwise(2.5)
    layer = 4 - bits(17, 3)
    table = F.create_map(*[x for (v, y), rates in BITRATES.items() for x in (F.lit(f"{v}-{y}"), F.array(*map(F.lit, rates)))])
    key = F.when(version == 1, F.concat(F.lit("1-"), layer.cast("string"))).otherwise(F.when(layer == 1, "2-1").otherwise("2-3"))
    hz = F.create_map(*[x for v, rs in RATES.items() for x in (F.lit(float(v)), F.array(*map(F.lit, rs)))])
    samples = F.when(layer == 1, 384).when((layer == 2) | (version == 1), 1152).otherwise(576)
    return F.when(_mpeg_sync(F.substring(_c(content), at + 1, 4)), F.struct(version.alias("version"), layer.alias("layer"), F.get(table[key], bits(12, 15)).alias("kbps"), F.get(hz[version], bits(10, 3)).alias("hz"), bits(6, 3).alias("mode"), samples.alias("samples")))


def id3v1(content) -> Column:
    """struct title, artist, album, year, comment, track of the trailing 128 bytes; null without a tag."""
    c = F.substring(_c(content), -128, 128)
    field = lambda a, n: F.nullif(F.trim(F.substring_index(F.decode(F.substring(c, a + 1, n), "ISO-8859-1"), "\0", 1)), F.lit(""))
    byte = lambda i: F.conv(F.hex(F.substring(c, i + 1, 1)), 16, 10).cast("int")
    track = F.when((byte(125) == 0) & (byte(126) > 0), byte(126))
    return F.when((F.length(_c(content)) > 128) & (F.substring(c, 1, 3) == _hex(b"TAG")), F.struct(field(3, 30).alias("title"), field(33, 30).alias("artist"), field(63, 30).alias("album"), field(93, 4).alias("year"), field(97, 28).alias("comment"), track.alias("track")))


# --- texts


def pdf_text(content) -> Column:
    """Bytes of a PDF string: UTF-16 or UTF-8 by their mark, else Latin-1; without trailing NULs."""
    b = _c(content)
    body = lambda n, encoding: F.decode(F.substring(b, n + 1, 1 << 30), encoding)
    mark = F.hex(F.substring(b, 1, 3))
    out = F.when(mark.startswith("FEFF"), body(2, "UTF-16BE")).when(mark.startswith("FFFE"), body(2, "UTF-16LE")).when(mark == "EFBBBF", body(3, "UTF-8")).otherwise(body(0, "ISO-8859-1"))
    return F.regexp_replace(out, "\\x00+$", "")


def font_name(s) -> Column:
    return F.replace(F.regexp_replace(_c(s), "^[A-Z]{6}\\+", ""), F.lit("#20"), F.lit(" "))


def escape_html(s) -> Column:
    out = F.coalesce(_c(s).cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def csv_quote(s) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(_c(s).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def from_hex(s) -> Column:
    return F.unhex(_c(s))


def remove_elements(xml, names: list[str]) -> Column:
    group = "|".join(n.replace(".", r"\.") for n in names)
    return F.regexp_replace(_c(xml), rf"(?s)<({group})\b[^>]*?(?:/>|>.*?</\1\s*>)", "")


def replace_attributes(xml, names: list[str], value: str) -> Column:
    return F.regexp_replace(_c(xml), rf"""(\s(?:{"|".join(names)})\s*=\s*)(?:"[^"]*"|'[^']*')""", f'$1"{value}"')


def bit_names(bits, names: list[tuple[int, str]]) -> Column:
    """Names of the bits that are set, in order."""
    pairs = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(n).alias("n")) for b, n in names])
    return F.transform(F.filter(pairs, lambda x: _c(bits).bitwiseAND(x["b"]) != 0), lambda x: x["n"])


# --- flags


def severity(flags) -> Column:
    """100 for each danger, 10 for each warn, 1 for each info; -1 without a report."""
    weight = lambda f: F.when(f["level"] == "danger", 100).when(f["level"] == "warn", 10).when(f["level"] == "info", 1).otherwise(0)
    return F.coalesce(F.aggregate(_c(flags), F.lit(0), lambda a, f: a + weight(f)), F.lit(-1))


def has_findings(flags) -> Column:
    return F.coalesce(F.exists(_c(flags), lambda f: f["level"] != "info"), F.lit(False))


def badge(mime, flags) -> Column:
    """struct text, color: the kind of file, with a mark and a colour by its worst flag."""
    worst = lambda *levels: F.exists(F.coalesce(_c(flags), F.array()), lambda f: f["level"].isin(*levels))
    return F.struct(F.concat(badge_base(mime), F.when(worst("danger", "warn"), "!").otherwise("")).alias("text"), F.when(worst("danger"), "red").when(worst("warn"), "orange").otherwise("green").alias("color"))


def flag_chips(flags, most: int = 99, levels: tuple[str, ...] = ("danger", "warn", "info")) -> Column:
    """The first texts of flags of these levels, then +N for the rest."""
    own = F.filter(_c(flags), lambda f: f["level"].isin(*levels))
    texts = F.transform(F.slice(own, F.lit(1), F.lit(most)), lambda f: f["text"])
    return F.when(F.size(own) > most, F.concat(texts, F.array(F.concat(F.lit("+"), (F.size(own) - most).cast("string"))))).otherwise(texts)


def pill_summary(info, flags, highlights, sections) -> Column:
    """Type label, number of flags that aren't info, the first three highlights; without any, the number of rows."""
    i, n = _c(info), F.size(F.filter(_c(flags), lambda f: f["level"] != "info"))
    rows = F.aggregate(_c(sections), F.lit(0), lambda a, s: a + F.size(s["rows"]))
    parts = F.concat(F.array(i["type_label"]), F.when(n > 0, F.array(F.concat(F.lit("⚠ "), n.cast("string")))).otherwise(F.array().cast("array<string>")), F.slice(_c(highlights), 1, 3))
    return F.when((n > 0) | (F.size(_c(highlights)) > 0), F.array_join(parts, " · ")).otherwise(F.concat(i["type_label"], F.lit(" · "), rows.cast("string"), F.lit(" fields")))


