"""Queries that extract from, and clean, small files of each format.

The files are assembled from rows of `part` by expressions, so SQL knows what their reports have to say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import clean_files
from ..operators.extraction import extract
from .queries import T, query


def be(x, n: int = 4) -> Column:
    return F.unhex(F.lpad(F.hex((x if isinstance(x, Column) else F.lit(x)).cast("long")), 2 * n, "0"))


def le(x, n: int = 4) -> Column:
    h = F.lpad(F.hex((x if isinstance(x, Column) else F.lit(x)).cast("long")), 2 * n, "0")
    return F.unhex(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(n))]))


def raw(x: bytes | str) -> Column:
    return F.unhex(F.lit((x.encode("latin-1") if isinstance(x, str) else x).hex()))


def text(x) -> Column:
    return F.encode(x if isinstance(x, Column) else F.lit(x), "UTF-8")


def sized(body: Column, number: Callable, extra: int = 0, n: int = 4) -> Column:
    return F.concat(number(F.length(body) + extra, n), body)


def width() -> Column:
    return F.col("p_partkey") % 1000 + 1


def jpeg() -> Column:
    tail = F.when(F.col("p_partkey") % 5 == 0, raw("x" * 20)).otherwise(raw(b""))
    frame = F.concat(raw(b"\xff\xc0\x00\x11\x08"), be(F.col("p_size"), 2), be(width(), 2), raw(b"\x03\x01\x11\x00\x02\x11\x01\x03\x11\x01"))
    return F.concat(raw(b"\xff\xd8\xff\xfe"), sized(text(F.col("p_name")), be, 2, 2), frame, raw(b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00\x11\xff\xd9"), tail)


def png() -> Column:
    def chunk(kind: str, body: Column) -> Column:
        return F.concat(be(F.length(body)), raw(kind), body, be(F.crc32(F.concat(raw(kind), body))))

    head = F.concat(be(width()), be(F.col("p_size")), raw(b"\x08\x02\x00\x00\x00"))
    return F.concat(raw(b"\x89PNG\r\n\x1a\n"), chunk("IHDR", head), chunk("tEXt", F.concat(raw(b"Author\0"), text(F.col("p_name")))), chunk("IEND", raw(b"")))


def gif() -> Column:
    note = text(F.col("p_name"))
    return F.concat(raw("GIF89a"), le(width(), 2), le(F.col("p_size"), 2), raw(b"\0\0\0!\xfe"), sized(note, be, 0, 1), raw(b"\0,\0\0\0\0\1\0\1\0\0\2\2\x4c\1\0;"))


def bmp() -> Column:
    return F.concat(raw("BM"), le(70), raw(bytes(4)), le(54), le(40), le(width()), le(F.col("p_size")), raw(b"\1\0\x18\0"), raw(bytes(24)), raw(bytes(16)))


def ico() -> Column:
    return F.concat(raw(b"\0\0\1\0\1\0"), be(F.col("p_size"), 1), raw(b"\0"), raw(bytes(14)))


def wav() -> Column:
    fmt = F.concat(raw("fmt "), le(16), raw(b"\1\0\2\0"), le(44100), le(176400), raw(b"\4\0\x10\0"))
    title = F.concat(text(F.col("p_name")), raw(b"\0"), F.when(F.length(text(F.col("p_name"))) % 2 == 0, raw(b"\0")).otherwise(raw(b"")))
    info = F.concat(raw("INFOINAM"), sized(title, le))
    body = F.concat(raw("WAVE"), fmt, raw("LIST"), sized(info, le), raw("data"), le(F.col("p_size") * 176400))
    return F.concat(raw("RIFF"), sized(body, le))


def mp3() -> Column:
    frame = F.concat(raw("TIT2"), sized(F.concat(raw(b"\3"), text(F.col("p_name"))), lambda n, _: F.concat(be(n), raw(b"\0\0"))))
    return F.concat(raw(b"ID3\3\0\0\0\0\0"), be(F.length(frame), 1), frame)


def flac() -> Column:
    pairs = F.concat(raw("TITLE="), text(F.col("p_name")))
    comments = F.concat(le(3), raw("enc"), le(1), sized(pairs, le))
    rate = F.concat(raw(bytes(10)), be(F.lit(44100 * 16 + 2), 3), raw(b"\xf0"), be(F.col("p_size") * 44100), raw(bytes(16)))
    return F.concat(raw("fLaC"), raw(b"\0\0\0\x22"), rate, raw(b"\x84"), sized(comments, be, 0, 3))


def mkv() -> Column:
    def el(id: str, body: Column) -> Column:
        return F.concat(raw(bytes.fromhex(id)), be(F.length(body) + (1 << 56), 8), body)

    return F.concat(el("1a45dfa3", el("4282", raw("webm"))), el("18538067", el("1549a966", F.concat(el("7ba9", text(F.col("p_name"))), el("5741", raw("Muxer"))))))


def mov() -> Column:
    def box(kind: Column, body: Column) -> Column:
        return F.concat(be(F.length(body) + 8), kind, body)

    title = F.concat(sized(text(F.col("p_name")), lambda n, _: F.concat(be(n, 2), raw(b"\0\0"))))
    place = F.concat(raw(b"\0\x11\0\0"), raw("+10.5000+020.2500"))
    user = box(raw("udta"), F.concat(box(raw(b"\xa9nam"), title), box(raw(b"\xa9xyz"), place)))
    return F.concat(box(raw("ftyp"), raw("qt  \0\0\0\0qt  ")), box(raw("moov"), user))


def ogg() -> Column:
    pairs = F.concat(raw("TITLE="), text(F.col("p_name")))
    head = F.concat(raw("OggS\0\0"), raw(bytes(21)), raw(b"OpusHead\1\2"), le(312, 2), le(48000), raw(bytes(3)))
    tags = F.concat(raw("OggS\0\0"), le(F.col("p_size") * 48000 + 312, 8), raw(bytes(13)), raw("OpusTags"), le(3), raw("enc"), le(1), sized(pairs, le))
    return F.concat(head, tags)


def pdf() -> Column:
    info = F.concat(F.lit("1 0 obj\n<< /Title ("), F.col("p_name"), F.lit(") /Author ("), F.col("p_brand"), F.lit(") >>\nendobj\n2 0 obj\n<< /Type /Catalog /Pages 3 0 R >>\nendobj\n3 0 obj\n<< /Type /Pages /Count "), F.col("p_size").cast("string"), F.lit(" >>\nendobj\n"))
    js = F.when(F.col("p_partkey") % 4 == 0, "4 0 obj\n<< /S /JavaScript /JS (x) >>\nendobj\n").otherwise("")
    return text(F.concat(F.lit("%PDF-1.4\n"), info, js, F.lit("trailer\n<< /Root 2 0 R /Info 1 0 R >>\n%%EOF\n")))


def archive() -> Column:
    name = text(F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, ".exe").otherwise(".txt")))
    body = text(F.col("p_type"))
    common = F.concat(raw(bytes(4)), raw(b"\0\0\x21\x58"), le(F.crc32(body)), le(F.length(body)), le(F.length(body)), le(F.length(name), 2), raw(b"\0\0"))
    local = F.concat(raw(b"PK\3\4\x14\0"), common, name, body)
    central = F.concat(raw(b"PK\1\2\x14\0\x14\0"), common, raw(bytes(14)), name)
    note = text(F.col("p_brand"))
    end = F.concat(raw(b"PK\5\6"), raw(bytes(4)), raw(b"\1\0\1\0"), le(F.length(central)), le(F.length(local)), sized(note, le, 0, 2))
    return F.concat(local, central, end)


def docx() -> Column:
    """An Office archive with two stored entries."""
    core = text(F.concat(F.lit("<c><dc:creator>"), F.col("p_name"), F.lit("</dc:creator></c>")))
    files = [(raw("[Content_Types].xml"), raw("<Types/>")), (raw("docProps/core.xml"), core), (raw("word/document.xml"), raw("<w/>"))]
    local, central, offset = raw(b""), raw(b""), F.lit(0)
    for name, body in files:
        common = F.concat(raw(bytes(4)), raw(b"\0\0\x21\x58"), le(F.crc32(body)), le(F.length(body)), le(F.length(body)), le(F.length(name), 2), raw(b"\0\0"))
        entry = F.concat(raw(b"PK\3\4\x14\0"), common, name, body)
        central = F.concat(central, raw(b"PK\1\2\x14\0\x14\0"), common, raw(bytes(10)), le(offset), name)
        local, offset = F.concat(local, entry), offset + F.length(entry)
    end = F.concat(raw(b"PK\5\6"), raw(bytes(4)), raw(b"\3\0\3\0"), le(F.length(central)), le(F.length(local)), raw(b"\0\0"))
    return F.concat(local, central, end)


def files(spark: SparkSession, sf_dir: str, content: Column) -> DataFrame:
    return T(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("file_id"), content.alias("content"))


def value(key: str) -> Column:
    rows = F.flatten(F.transform("sections", lambda s: s["rows"]))
    return F.get(F.filter(rows, lambda x: x["k"] == key), F.lit(0))["v"]


def has(code: str) -> Column:
    return F.exists("flags", lambda f: f["code"] == code)


W = "CAST(p_partkey % 1000 + 1 AS DOUBLE)"
#: Query, file, columns of the report, and what SQL says they are.
REPORTS = (
    ("e01_jpeg", jpeg, lambda: {"label": F.col("info.type_label"), "comment": value("Comment (COM)"), "w": F.col("info.width"), "h": F.col("info.height"), "sampling": value("Chroma subsampling"), "trailing": has("trailing")}, f"'JPEG' AS label, p_name AS comment, {W} AS w, CAST(p_size AS DOUBLE) AS h, '4:4:4' AS sampling, p_partkey % 5 = 0 AS trailing"),
    ("e02_png", png, lambda: {"label": F.col("info.type_label"), "author": value("Author"), "w": F.col("info.width"), "h": F.col("info.height"), "chunks": value("Chunks")}, f"'PNG' AS label, p_name AS author, {W} AS w, CAST(p_size AS DOUBLE) AS h, 'IHDR, tEXt, IEND' AS chunks"),
    ("e03_gif", gif, lambda: {"label": F.col("info.type_label"), "comment": value("Comment"), "w": F.col("info.width"), "frames": value("Frame count")}, f"'GIF' AS label, p_name AS comment, {W} AS w, '1' AS frames"),
    ("e06_bmp", bmp, lambda: {"label": F.col("info.type_label"), "w": F.col("info.width"), "h": F.col("info.height"), "bits": value("Bits/pixel")}, f"'BMP' AS label, {W} AS w, CAST(p_size AS DOUBLE) AS h, '24' AS bits"),
    ("e07_ico", ico, lambda: {"label": F.col("info.type_label"), "sizes": value("Sizes")}, "'ICO' AS label, p_size || '×256' AS sizes"),
    ("e09_pdf", pdf, lambda: {"label": F.col("info.type_label"), "title": F.col("info.title"), "author": value("Author"), "pages": F.col("info.pages"), "js": has("pdf-js"), "version": value("PDF version")}, "'PDF' AS label, p_name AS title, p_brand AS author, CAST(p_size AS BIGINT) AS pages, p_partkey % 4 = 0 AS js, '1.4' AS version"),
    ("e10_mov", mov, lambda: {"label": F.col("info.type_label"), "title": value("Title (©nam)"), "lat": F.col("gps.lat"), "lon": F.col("gps.lon"), "danger": has("gps")}, "'MOV (QuickTime)' AS label, p_name AS title, 10.5::DOUBLE AS lat, 20.25::DOUBLE AS lon, true AS danger"),
    ("e12_mp3", mp3, lambda: {"label": F.col("info.type_label"), "title": value("Title (TIT2)"), "version": value("ID3 version")}, "'MP3' AS label, p_name AS title, '2.3.0' AS version"),
    ("e15_flac", flac, lambda: {"label": F.col("info.type_label"), "title": value("TITLE"), "format": value("Format"), "seconds": F.col("info.duration")}, "'FLAC' AS label, p_name AS title, 'FLAC · 44100 Hz · 2 channels · 16 bit' AS format, CAST(p_size AS DOUBLE) AS seconds"),
    ("e18_ogg", ogg, lambda: {"label": F.col("info.type_label"), "title": value("TITLE"), "seconds": F.col("info.duration")}, "'OGG Opus' AS label, p_name AS title, CAST(p_size AS DOUBLE) AS seconds"),
    ("e19_wav", wav, lambda: {"label": F.col("info.type_label"), "title": value("Title (INAM)"), "format": value("Format"), "seconds": F.col("info.duration")}, "'WAV' AS label, p_name AS title, 'PCM · 2 channels · 44100 Hz · 16 bit' AS format, CAST(p_size AS DOUBLE) AS seconds"),
    ("e20_mkv", mkv, lambda: {"label": F.col("info.type_label"), "title": F.col("info.title"), "app": value("WritingApp")}, "'WebM' AS label, p_name AS title, 'Muxer' AS app"),
    ("e23_zip", archive, lambda: {"label": F.col("info.type_label"), "comment": value("Archive comment"), "entries": value("Entries"), "executable": has("zip-executable")}, "'ZIP' AS label, p_brand AS comment, '1' AS entries, p_partkey % 3 = 0 AS executable"),
    ("e24_docx", docx, lambda: {"label": F.col("info.type_label"), "author": value("Author (creator)"), "flagged": has("author")}, "'DOCX' AS label, p_name AS author, true AS flagged"),
)


def _report(make: Callable[[], Column], columns: Callable[[], dict[str, Column]]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return extract(files(spark, sf_dir, make())).select("file_id", *[c.alias(n) for n, c in columns().items()])

    return run


for _name, _make, _columns, _sql in REPORTS:
    query(_name, f"SELECT CAST(p_partkey AS VARCHAR) AS file_id, {_sql} FROM part")(_report(_make, _columns))

N = "strlen(p_name)"
#: Query, file, and by SQL: the labels of what is removed with bytes, the bytes that stay.
CLEANINGS = (
    ("c01_jpeg_clean", jpeg, f"'JPEG comment:' || ({N} + 4) || CASE WHEN p_partkey % 5 = 0 THEN ',Trailing data (after EOI):20' ELSE '' END AS removed, CAST(34 AS INT) AS size, 'jpg' AS ext, NULL AS error"),
    ("c02_png_clean", png, f"'Text (tEXt):' || ({N} + 19) AS removed, CAST(45 AS INT) AS size, 'png' AS ext, NULL AS error"),
    ("c04_gif_clean", gif, f"'GIF comment:' || ({N} + 4) AS removed, CAST(29 AS INT) AS size, 'gif' AS ext, NULL AS error"),
    ("c06_pdf_clean", pdf, "'Document info dictionary (author, application, dates):' || (strlen(p_name) + strlen(p_brand) + 26) AS removed, CAST(strlen(p_name) + strlen(p_brand) + strlen(CAST(p_size AS VARCHAR)) + 186 + CASE WHEN p_partkey % 4 = 0 THEN 44 ELSE 0 END AS INT) AS size, 'pdf' AS ext, NULL AS error"),
    ("c07_mov_clean", mov, f"'User data (GPS, device, software, cover):' || ({N} + 49) AS removed, CAST({N} + 77 AS INT) AS size, 'mov' AS ext, NULL AS error"),
    ("c08_mp3_clean", mp3, f"'ID3v2 tag (title, artist, cover, comments):' || ({N} + 21) AS removed, CAST(0 AS INT) AS size, 'mp3' AS ext, NULL AS error"),
    ("c09_flac_clean", flac, f"'Vorbis comments (tags):' || ({N} + 25) AS removed, CAST(42 AS INT) AS size, 'flac' AS ext, NULL AS error"),
    ("c10_wav_clean", wav, f"'LIST INFO (title, artist, software):' || (20 + {N} + 2 - {N} % 2) AS removed, CAST(44 AS INT) AS size, 'wav' AS ext, NULL AS error"),
    ("c11_docx_clean", docx, "'Document properties (author, last modified by, dates, title):0' AS removed, CAST(375 AS INT) AS size, 'zip' AS ext, NULL AS error"),
    ("c13_refusals", mkv, "'' AS removed, CAST(NULL AS INT) AS size, CAST(NULL AS VARCHAR) AS ext, 'Cleaning is not supported for MKV' AS error"),
)


def _cleaning(make: Callable[[], Column]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = clean_files(files(spark, sf_dir, make()))
        removed = F.array_join(F.transform("removed", lambda r: F.concat(r["label"], F.lit(":"), r["bytes"].cast("string"))), ",")
        return out.select("file_id", removed.alias("removed"), F.length("bytes").alias("size"), "ext", "error")

    return run


for _name, _make, _sql in CLEANINGS:
    query(_name, f"SELECT CAST(p_partkey AS VARCHAR) AS file_id, {_sql} FROM part")(_cleaning(_make))


@query(
    "r18_clean_verified",
    "SELECT CAST(p_partkey AS VARCHAR) AS file_id, 'gps' AS code, true AS removed FROM part",
)
def clean_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scan import clean_and_verify

    return clean_and_verify(files(spark, sf_dir, mov()))[2]
