"""Queries that extract from, and clean, files with many tags: sample files in which a row of `supplier` fills some fields.

A field's text is replaced by one of the same length, so the file stays valid without writing it anew; archives are
written by expressions. SQL says what the reports have to hold.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import clean_files, removal_log
from ..operators.extraction import extract
from .built import be, has, le, raw, text, value
from .queries import T, query
from .samples import XMP, id3, iptc, sample, tiff

KEY, KEY_SQL = "concat(cast(s_suppkey as string), '-', s_name)", "(s_suppkey || '-' || s_name)"
DEGREES = "s_suppkey % 90"


def filled(n: int, encoding: str = "UTF-8") -> Column:
    """The row's text at a length of n, padded by dots."""
    return F.encode(F.expr(f"rpad(substr({KEY}, 1, {n}), {n}, '.')"), encoding)


def said(n: int) -> str:
    """The same in SQL."""
    return f"rpad(substr({KEY_SQL}, 1, {n}), {n}, '.')"


def spliced(template: bytes, fields: dict[bytes, Column]) -> Column:
    """template with some of its bytes, each of which occurs in it once, replaced by columns of the same length."""
    out, at = [], 0
    for place, field in sorted((template.index(f), f) for f in fields):
        out += [raw(template[at:place]), fields[field]]
        at = place + len(field)
    return F.concat(*out, raw(template[at:]))


def texts(*fields: str, encoding: str = "UTF-8") -> dict[bytes, Column]:
    return {f.encode("utf-16-le" if "16" in encoding else "utf-8"): filled(len(f), encoding) for f in fields}


def latitude(order: str) -> dict[bytes, Column]:
    """The degrees of the samples' latitude, from the row's key."""
    return {struct.pack(order + "IIII", 6000, 100, 2300, 100): F.concat((le if order == "<" else be)(F.expr(DEGREES) * 100), raw(struct.pack(order + "III", 100, 2300, 100)))}


def stored_zip(*entries: tuple[str, Column], note: str = "") -> Column:
    """An archive without compression."""
    local, central, offset = raw(b""), raw(b""), F.lit(0)
    for name, body in entries:
        common = F.concat(raw(bytes(4)), raw(b"\0\0\x21\x58"), le(F.crc32(body)), le(F.length(body)), le(F.length(body)), le(F.lit(len(name)), 2), raw(b"\0\0"))
        entry = F.concat(raw(b"PK\3\4\x14\0"), common, raw(name), body)
        central = F.concat(central, raw(b"PK\1\2\x14\0\x14\0"), common, raw(bytes(10)), le(offset), raw(name))
        local, offset = F.concat(local, entry), offset + F.length(entry)
    n = len(entries)
    return F.concat(local, central, raw(b"PK\5\6" + struct.pack("<HHHH", 0, 0, n, n)), le(F.length(central)), le(F.length(local)), le(F.lit(len(note)), 2), raw(note))


def put(*parts) -> Column:
    """Bytes of texts and of the row's own ({}: 12 characters of it)."""
    return F.concat(*[filled(12) if p == "{}" else text(p) for p in parts])


def icc(description: Column) -> Column:
    """A profile with one description tag of 13 bytes of text."""
    head = struct.pack(">I4s4s4s4s4s", 0, b"lcms", b"\2\x40\0\0", b"mntr", b"RGB ", b"XYZ ") + struct.pack(">6H", 2024, 1, 2, 3, 4, 5) + b"acspAPPL" + bytes(4) + b"Opti" + bytes(76)
    return F.concat(raw(head[:128].ljust(128, b"\0") + struct.pack(">I4sII", 1, b"desc", 144, 40) + b"desc" + bytes(4) + struct.pack(">I", 13)), description, raw(bytes(15)))


def jpeg_with(marker: int, body: Column) -> Column:
    return F.concat(raw(b"\xff\xd8\xff" + bytes([marker])), be(F.length(body) + 2, 2), body, raw(b"\xff\xc0\x00\x11\x08\0\x08\0\x08\x03\x01\x11\x00\x02\x11\x01\x03\x11\x01\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00\x11\xff\xd9"))


def mp3_xing() -> Column:
    """A variable bit rate file that says how many frames it has."""
    frame = F.concat(raw(b"\xff\xfb\x90\x64" + bytes(32) + b"Xing\0\0\0\3"), be(F.expr("s_suppkey % 5000 + 100")), be(F.lit(4170)), raw(bytes(413 - 32 - 16)))
    return F.concat(frame, raw((b"\xff\xfb\x90\x64" + bytes(413)) * 9))


def m4a_items() -> Column:
    """Items of each kind of data: signed and unsigned whole numbers, a float, UTF-16."""

    def box(kind: bytes, *parts: Column) -> Column:
        body = F.concat(*parts)
        return F.concat(be(F.length(body) + 8), raw(kind), body)

    data = lambda kind, body: box(b"data", raw(struct.pack(">II", kind, 0)), body)
    items = box(b"ilst", box(b"\xa9alb", data(2, filled(8, "UTF-16BE"))), box(b"tmpo", data(21, raw(b"\xff\xfe"))), box(b"cpil", data(67, raw(b"\xff\xfe"))), box(b"pgap", data(22, be(F.expr("s_suppkey % 200 + 1"), 1))), box(b"rtng", data(23, raw(struct.pack(">f", 1.5)))))
    meta = box(b"meta", raw(bytes(4)), box(b"hdlr", raw(bytes(8) + b"mdir" + bytes(12))), items)
    return F.concat(box(b"ftyp", raw(b"M4A \0\0\0\0M4A ")), box(b"moov", box(b"udta", meta)))


def encrypted() -> Column:
    """One of six encrypted documents, with as many pages as the row says."""
    kinds = ("rc4_40", "rc4_128", "aes128", "aes256r5", "aes256", "userpw")
    files = [spliced(sample(f"enc_{k}.pdf"), {b"/Count 1 ": F.concat(raw("/Count "), text(F.expr("cast(s_suppkey % 9 + 1 as string)")), raw(" "))}) for k in kinds]
    out = files[-1]
    for k in reversed(range(5)):
        out = F.when(F.expr(f"s_suppkey % 6 = {k}"), files[k]).otherwise(out)
    return out


def within(section: str, key: str) -> Column:
    rows = F.flatten(F.transform(F.filter("sections", lambda s: s["id"] == section), lambda s: s["rows"]))
    return F.get(F.filter(rows, lambda x: x["k"] == key), F.lit(0))["v"]


LAT, LON = (F.round, "gps.lat", f"round({DEGREES} + 23 / 60.0::DOUBLE + 34.8 / 3600::DOUBLE, 3)"), "5.324::DOUBLE"


def _gps() -> dict:
    return {"lat": (lambda: F.round("gps.lat", 3), LAT[2]), "lon": (lambda: F.round("gps.lon", 3), LON), "flagged": (lambda: has("gps"), "true")}


def _v(key: str, sql: str):
    return (lambda: value(key)), sql


def _in(section: str, key: str, sql: str):
    return (lambda: within(section, key)), sql


def _info(name: str, sql: str):
    return (lambda: F.col(f"info.{name}")), sql


def _has(code: str, sql: str = "true"):
    return (lambda: has(code)), sql


XMP_DONE = {"tool": _v("xmp:CreatorTool", "'Painter 9'"), "creator": _v("dc:creator", said(9)), "xmp_title": _v("dc:title", "'A title'")}
CAMERA = {"make": _v("Make", "'Optika'"), "model": _v("Model", said(8)), "turned": _v("Orientation", "'Rotated 90° CW'"), "taken": _v("DateTimeOriginal", "'2024:01:02 03:04:05'"), "exposure": _v("ExposureTime", "'1/250 s'"), "lens": _v("LensModel", "'ZM24-105mm'"), "altitude": _v("GPSAltitude", "'35'")}
SIX = ("RC4 (R2)", "RC4 (R3)", "AES-128 (R4)", "AES-256 (R5)", "AES-256 (R6)", "RC4 (R3)")
#: Query, file, and each column of it: of the report, and in SQL.
REPORTS = (
    ("e04_webp", lambda: spliced(sample("c.webp"), texts("Model M5", "Nils Berg") | latitude("<")), CAMERA | XMP_DONE | _gps() | {"features": _v("Features", "'EXIF, XMP'"), "w": _info("width", "100::DOUBLE"), "h": _info("height", "50::DOUBLE")}),
    ("e05_tiff", lambda: spliced(sample("d.tif"), texts("Model M5") | latitude("<")), CAMERA | _gps() | {"label": _info("type_label", "'TIFF'")}),
    ("e21_exif", lambda: spliced(sample("a.jpg"), texts("Model M5", "987654") | latitude("<")), CAMERA | _gps() | {"serial": _v("SerialNumber", said(6)), "software": _v("Software", "'Editor1'"), "density": _v("Density", "'72 × 72 dpi'")}),
    ("e21_exif_big_endian", lambda: spliced(sample("b.png"), texts("Model M5")), {"model": _v("Model", said(8)), "lat": (lambda: F.col("gps.lat"), "-40::DOUBLE"), "lon": (lambda: F.col("gps.lon"), "-10::DOUBLE"), "packed": _v("Author", "'Lena'"), "changed": _v("Modification time (tIME)", "NULL::VARCHAR")}),
    ("e22_xmp_iptc", lambda: spliced(sample("a.jpg"), texts("Nils Berg", "Bergen", "Someone")), XMP_DONE | {"city": _in("iptc", "City", said(6)), "by": _in("iptc", "By-line", said(7)), "contact": _has("iptc-contact")}),
    ("e22_icc", lambda: jpeg_with(0xE2, F.concat(raw(b"ICC_PROFILE\0\1\1"), icc(F.concat(filled(12), raw(b"\0"))))), {"profile": _in("icc", "Description", said(12)), "space": _in("icc", "Class / Color space", "'mntr / RGB'"), "made": _in("icc", "Profile date", "'2024-01-02 03:04:05'")}),
    ("e09d_streams", lambda: spliced(sample("j.pdf"), texts("Maker")), {"producer": _v("Producer", said(5)), "title": _info("title", "'Übersicht'"), "author": _v("Author", "'Can (test) é'"), "made": _v("Creation date", "'2024-01-02 03:04:05 +03:00'"), "tool": _in("xmp", "xmp:CreatorTool", "'Painter 9'"), "creator": _in("xmp", "dc:creator", "'Nils Berg'"), "script": _has("pdf-js"), "hidden_names": _in("pdf-sec", "Hex-obfuscated names", "'2'"), "packed": _in("pdf-sec", "/ObjStm", "'1'")}),
    ("e09k_structure", lambda: spliced(sample("j.pdf"), {b"02" * 16: text(F.expr("lpad(lower(hex(s_suppkey)), 32, '0')"))}), {"ids": _in("pdf-struct", "Document ID", "repeat('01', 16) || ' / ' || lpad(lower(format('{:x}', s_suppkey)), 32, '0')"), "language": _in("pdf-struct", "Language", "'en'"), "pages": _info("pages", "2::BIGINT"), "revisions": _in("pdf-struct", "Revisions (incremental updates)", "'2'"), "opens": _in("pdf-sec", "/OpenAction", "'1'")}),
    ("e09m_embedded", lambda: spliced(sample("k.pdf"), texts("Info author", "Owner of the picture", "A hidden extra", "Model M5") | latitude("<")), {"author": _in("pdf-info", "Author", said(11)), "owner": _in("oxmp-9", "dc:creator", said(20)), "model": _in("embedded-6", "Model", said(8)), "attached": _in("pdf-files", "report.docm", f"'99 B · text/plain · ' || {said(14)} || ' · created 2024-01-01 00:00:00'"), "inside": _in("embedded-8", "Entries", "'12'"), "files": _in("pdf-sec", "/EmbeddedFiles", "'1'"), "lat": _gps()["lat"]}),
    ("e09i_encryption", encrypted, {"author": _in("pdf-info", "Author", "CASE WHEN s_suppkey % 6 < 5 THEN 'Hidden Writer' END"), "cipher": _in("pdf-struct", "Encryption", "CASE s_suppkey % 6 " + " ".join(f"WHEN {k} THEN 'Standard · {s}'" for k, s in enumerate(SIX)) + " END"), "pages": _info("pages", "(s_suppkey % 9 + 1)::BIGINT"), "locked": _info("encrypted", "true"), "marked": _in("pdf-sec", "/Encrypt", "'1'")}),
    ("e10a_items", m4a_items, {"album": _v("Album (©alb)", said(8)), "tempo": _v("tmpo", "'-2'"), "parts": _v("cpil", "'65534'"), "gapless": _v("pgap", "(s_suppkey % 200 + 1)::VARCHAR"), "rating": _v("rtng", "'1.5'")}),
    ("e10b_keys", lambda: spliced(sample("zd.mov"), texts("Phone 15", "Soft 1.41")), {"model": _v("quicktime.model", said(8)), "software": _v("Software (©swr)", said(9)), "lat": (lambda: F.col("gps.lat"), "60.3913::DOUBLE"), "lon": (lambda: F.col("gps.lon"), "5.3221::DOUBLE")}),
    ("e10d_tracks", lambda: spliced(sample("zd.mov"), texts("H.264")), {"track": _in("media-tracks", "Track 1", f"'Video · avc1 · 1920×1080 · 0:42 · eng · “' || {said(5)} || '”'"), "created": _v("Creation time (mvhd)", "'2024-01-01 00:00:00 UTC'"), "seconds": _info("duration", "42::DOUBLE"), "w": _info("width", "1920::DOUBLE")}),
    ("e10a_cover", lambda: spliced(sample("x.m4a"), texts("Episode 1", "Model M5") | latitude("<")), {"title": _v("Title (©nam)", said(9)), "note": _v("iTunes:NOTE", "'x'"), "model": _in("embedded-2", "Model", said(8)), "shown": (lambda: F.col("thumbnail").isNotNull(), "true")} | _gps()),
    ("e11_heif", lambda: spliced(sample("g.heic"), texts("Model M5") | latitude("<")), CAMERA | _gps() | {"label": _info("type_label", "'HEIF/HEIC'"), "w": _info("width", "4000::DOUBLE"), "brands": _v("Compatible brands", "'mif1, heic'")}),
    ("e12_id3_frames", lambda: spliced(sample("z.mp3"), texts("hidden remark", "Room 5", "V1 title") | latitude("<")), {"remark": _v("Comment (COMM) about [eng]", said(13)), "room": _v("TXXX:Recorder", said(6)), "title": _v("Title (TIT2)", "'Şarkı'"), "old": _in("id3v1", "Title", said(8)), "track": _in("id3v1", "Track", "'5'"), "lat": _gps()["lat"], "rate": _in("audio", "Bitrate", "'128 kbps'")}),
    ("e13_xing", mp3_xing, {"seconds": (lambda: F.round("info.duration", 3), "round((s_suppkey % 5000 + 100) * 1152 / 44100.0::DOUBLE, 3)"), "rate": _in("audio", "Sample rate", "'44100 Hz'")}),
    ("e16_flac_cover", lambda: spliced(sample("y.flac"), texts("A track", "Some PC", "Model M5") | latitude("<")), {"title": _v("TITLE", said(7)), "by": _v("ENCODED_BY", said(7)), "cover": _v("Cover art", "'image/jpeg 1×1 · 1.1 KB'"), "model": _in("embedded-2", "Model", said(8))} | _gps()),
    ("e19_avi", lambda: spliced(sample("zc.avi"), texts("CamMVI_007")), {"software": _v("Software (ISFT)", said(10)), "streams": _v("Streams", "'vids:MJPG'"), "rate": _v("Frame rate", "'25 fps'"), "seconds": _info("duration", "10::DOUBLE")}),
    ("e20_mkv_tags", lambda: spliced(sample("zb.mkv"), texts("Muxer 3.1", "Coder 60", "A film")), {"app": _v("WritingApp", said(9)), "coder": _v("ENCODER", said(8)), "title": _info("title", said(6)), "font": _v("Attachment: font.ttf", "'font/ttf'"), "track": _in("media-tracks", "Track 1", "'Video · V_MPEG4/ISO/AVC · 1920×1080'"), "made": _v("Creation time (DateUTC)", "'2024-01-01 00:00:00 UTC'"), "seconds": _info("duration", "93.5::DOUBLE")}),
    ("e24_docm", lambda: stored_zip(("[Content_Types].xml", raw("<Types/>")), ("docProps/core.xml", put("<p><dc:creator>", "{}", "</dc:creator><cp:lastModifiedBy>Lena Voss</cp:lastModifiedBy></p>")), ("docProps/app.xml", put("<p><Company>", "{}", "</Company><TotalTime>245</TotalTime></p>")), ("word/document.xml", put('<w:document><w:ins w:id="1" w:author="', "{}", '"/><w:vanish/></w:document>')), ("word/vbaProject.bin", raw("vba"))), {"author": _v("Author (creator)", said(12)), "last": _v("Last modified by", "'Lena Voss'"), "company": _v("Company", said(12)), "edited": _v("Total editing time", "'245 min (4:05)'"), "changed_by": _v("Tracked-change authors", said(12)), "macros": _has("macro"), "label": _info("type_label", "'DOCX (with macros)'")}),
    ("e24_xlsx", lambda: stored_zip(("[Content_Types].xml", raw("<Types/>")), ("xl/workbook.xml", put('<workbook><x15ac:absPath url="C:\\Users\\', "{}", '\\"/><sheets><sheet name="Open" sheetId="1"/><sheet name="Pay" sheetId="2" state="hidden"/></sheets></workbook>')), ("xl/comments1.xml", put("<comments><authors><author>", "{}", "</author></authors></comments>"))), {"folder": _v("Original save folder", rf"'C:\Users\' || {said(12)} || '\'"), "by": _v("Comment authors", said(12)), "label": _info("type_label", "'XLSX'")}),
    ("e25_odt", lambda: stored_zip(("mimetype", raw("application/vnd.oasis.opendocument.text")), ("meta.xml", put("<office:meta><meta:initial-creator>", "{}", "</meta:initial-creator><meta:editing-duration>PT2H30M5S</meta:editing-duration><meta:generator>LO 7</meta:generator></office:meta>")), ("Basic/Standard/Module1.xml", raw("<x/>"))), {"author": _v("Initial author", said(12)), "label": _info("type_label", "'ODT'"), "edited": _v("Editing duration", "'2:30:05'"), "macros": _has("macro")}),
    ("e26_epub", lambda: stored_zip(("mimetype", raw("application/epub+zip")), ("OEBPS/content.opf", put("<package><metadata><dc:creator>", "{}", '</dc:creator><dc:title>Book</dc:title><meta name="generator" content="Maker 7"/></metadata></package>'))), {"author": _v("dc:creator", said(12)), "maker": _v("generator", "'Maker 7'"), "label": _info("type_label", "'EPUB'")}),
    ("e26_jar", lambda: stored_zip(("META-INF/MANIFEST.MF", put("Manifest-Version: 1.0\r\nBuilt-By: ", "{}", "\r\n")), ("a.class", raw("x"))), {"by": _v("Built-By", said(12)), "label": _info("type_label", "'JAR (Java)'")}),
    ("e27_doc", lambda: spliced(sample("u.doc"), texts("Old Author")), {"author": _in("doc-props", "Author", said(10)), "last": _in("doc-props", "Last saved by", "'Anna'"), "made": _in("doc-props", "Created", "'2024-01-01 00:00:00 UTC'"), "pages": _info("pages", "7::BIGINT"), "label": _info("type_label", "'DOC (Word 97-2003)'")}),
    ("e28_msg", lambda: spliced(sample("u.msg"), texts("A Sender", "Hello", encoding="UTF-16LE")), {"subject": _in("mail", "Subject", said(5)), "sender": _in("mail", "Sender name", said(8)), "headers": _in("mail", "IP addresses in headers", "'10.1.2.3'")}),
)


def _report(make, columns):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return extract(_files(spark, sf_dir, make())).select("file_id", *[c().alias(n) for n, (c, _) in columns.items()])

    return run


for _name, _make, _columns in REPORTS:
    query(_name, f"SELECT CAST(s_suppkey AS VARCHAR) AS file_id, {', '.join(f'{sql} AS {n}' for n, (_, sql) in _columns.items())} FROM supplier")(_report(_make, _columns))



def _removed(name: str) -> tuple[dict[str, int], int]:
    """Labels with bytes of what cleaning has to remove from a sample, and the size that is left. Sizes are those of the sample's parts."""
    b, exif, xmp = sample(name), len(tiff()), len(XMP.encode())
    if name == "a.jpg":
        parts = {"EXIF (camera, GPS, date, thumbnail)": exif + 10, "XMP": xmp + 33, "IPTC / Photoshop": len(iptc()) + 4, "JPEG comment": 20, "Trailing data (after EOI)": 130}
        return parts, len(b) - sum(parts.values()) + 36  # a segment of 36 bytes keeps the orientation
    if name == "b.png":
        parts = {"Modification time (tIME)": 19, "Text (tEXt)": 2 * 12 + 13 + 19, "Text (zTXt)": 12 + 8 + len(zlib.compress(b"Lena")), "Text / XMP (iTXt)": 12 + 22 + xmp, "EXIF (eXIf)": 12 + exif, "Trailing data (after IEND)": 13}
        return parts, len(b) - sum(parts.values())
    if name == "c.webp":
        parts = {"EXIF": 8 + exif + exif % 2, "XMP": 8 + xmp + xmp % 2}
        return parts, len(b) - sum(parts.values())
    if name == "j.pdf":
        return {"Document info dictionary (author, application, dates)": b.index(b"\nendobj", b.index(b"3 0 obj")) - b.index(b"3 0 obj") - 8, "XMP metadata stream": len(zlib.compress(XMP.encode()))}, len(b)
    if name == "g.heic":
        return {"EXIF item (camera, GPS)": exif + 10}, len(b)
    parts = {"ID3v2 tag (title, artist, cover, comments)": len(id3()), "ID3v1 tag": 128, "APE tag": 32}
    return parts, len(b) - sum(parts.values())


#: Query, sample, the fields that a row fills, extension.
CLEANINGS = (
    ("c01_jpeg_tags_clean", "a.jpg", ("Model M5", "Nils Berg"), "jpg"),
    ("c02_png_tags_clean", "b.png", ("Model M5",), "png"),
    ("c03_webp_clean", "c.webp", ("Model M5", "Nils Berg"), "webp"),
    ("c06_pdf_streams_clean", "j.pdf", ("Maker",), "pdf"),
    ("c07_heic_clean", "g.heic", ("Model M5",), "heic"),
    ("c08_mp3_tags_clean", "z.mp3", ("Room 5",), "mp3"),
)


def _files(spark: SparkSession, sf_dir: str, content: Column) -> DataFrame:
    """A file for each supplier. The table is a few bytes a file, so its rows are dealt to all cores before files are made of them."""
    dealt = T(spark, sf_dir, "supplier").repartition(spark.sparkContext.defaultParallelism, "s_suppkey")
    return dealt.select(F.col("s_suppkey").cast("string").alias("file_id"), content.alias("content"))


def _cleaning(name: str, fields: tuple[str, ...]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = clean_files(_files(spark, sf_dir, spliced(sample(name), texts(*fields))))
        removed = F.array_join(F.transform("removed", lambda r: F.concat(r["label"], F.lit(":"), r["bytes"].cast("string"))), ",")
        left = F.contains(F.col("bytes"), F.encode(F.concat("file_id", F.lit("-S")), "UTF-8"))  # as each field begins
        return out.select("file_id", removed.alias("removed"), F.length("bytes").alias("size"), "ext", "error", left.alias("left_over"))

    return run


for _name, _sample, _fields, _ext in CLEANINGS:
    _parts, _size = _removed(_sample)
    _said = ",".join(f"{k}:{n}" for k, n in _parts.items())
    query(_name, f"SELECT CAST(s_suppkey AS VARCHAR) AS file_id, '{_said}' AS removed, CAST({_size} AS INT) AS size, '{_ext}' AS ext, CAST(NULL AS VARCHAR) AS error, false AS left_over FROM supplier")(_cleaning(_sample, _fields))


@query("r18_tags_verified", "SELECT CAST(s_suppkey AS VARCHAR) AS file_id, unnest(['gps', 'serial', 'owner', 'iptc-contact', 'trailing']) AS code, true AS removed FROM supplier")
def tags_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scan import clean_and_verify

    return clean_and_verify(_files(spark, sf_dir, spliced(sample("a.jpg"), texts("Model M5") | latitude("<"))))[2]


_PARTS = _removed("a.jpg")[0]


@query(
    "r11_removals",
    " UNION ALL ".join(f"SELECT '{label}' AS label, count(*) AS files, count(*) AS n, count(*) * {n} AS bytes FROM supplier" for label, n in _PARTS.items()),
)
def removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_log(clean_files(_files(spark, sf_dir, spliced(sample("a.jpg"), texts("Model M5")))))
