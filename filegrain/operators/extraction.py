"""Extraction as a DataFrame stage: binary files with their transport details -> one report row a file.

The type is detected natively and comes in as a column; only content and what the report quotes crosses to Python,
in Arrow batches. A file that can't be parsed gives a report with a warning; it never fails the job.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import native
from .extract import PARSERS, Report, load
from .extract.binary import size_text
from .extract.detect import TYPES, sniff
from .extract.exif import emit_xmp, find_xmp

REPORT = """file_id string,
info struct<url:string,name:string,size:bigint,type:string,type_label:string,category:string,mime:string,width:double,height:double,pages:bigint,duration:double,title:string,encrypted:boolean,partial:boolean>,
flags array<struct<code:string,level:string,text:string>>, highlights array<string>, warnings array<string>,
gps struct<lat:double,lon:double,alt:double,source:string>, thumbnail binary,
sections array<struct<id:string,title:string,rows:array<struct<k:string,v:string,s:boolean>>>>"""
SENSITIVE_HEADER = re.compile("server|powered|last-modified|x-amz|x-goog|x-ms|via|x-served|x-backend|x-host|x-cache|cf-ray|content-disposition", re.I)
INPUT = ("file_id", "content", "type", "name", "url", "final_url", "referrer", "content_type", "headers", "last_modified", "partial", "via_background")


def register_extractor(kind: str, f: Callable[[bytes, Report], None], label: str | None = None, category: str = "doc") -> None:
    """Use f for files of a type; a new type needs a label. Registered before a query is built, it travels with the query."""
    load()
    PARSERS[kind] = f
    TYPES[kind] = (label or TYPES.get(kind, (kind.upper(),))[0], category, kind)


def analyse(content: bytes, meta: dict, parsers: dict | None = None, types: dict | None = None) -> dict:
    """The report row of one file."""
    parsers, types = parsers or load(), types or TYPES
    b = bytes(content or b"")
    kind = meta.get("type") or sniff(b)
    partial = meta.get("partial")
    R = Report(partial=partial)
    label, category, name = types.get(kind, ("Unknown", None, None))
    mime = (meta.get("content_type") or "").split(";")[0].strip().lower()
    total = partial["total"] if partial else len(b)
    R.info = {"url": meta.get("url"), "name": meta.get("name"), "size": total, "type": kind, "type_label": label, "category": category, "mime": mime or None}
    if name not in parsers:
        R.warn("Unrecognized file type — this may not be a supported image, PDF, document or media file.")
    else:
        try:
            parsers[name](b, R)
            if kind not in ("pdf", "svg", "zip", "ole") and not R.has("xmp") and (x := find_xmp(b)):
                emit_xmp(R, x)
        except Exception as e:  # untrusted bytes: whatever a parser trips over belongs in this file's report
            R.warn(f"Parse error: {e}")
    if meta.get("via_background"):
        R.warnings.insert(0, "Direct download was refused; the file was fetched in the background with the source page as Referer.")
    file_section(R, b, meta, mime, total)
    headers = {str(k): v for k, v in (meta.get("headers") or [])} if not isinstance(meta.get("headers"), dict) else meta["headers"]
    if headers:
        s = R.section("http", "HTTP response headers")
        for k, v in sorted(headers.items()):
            s.add(k, v, bool(SENSITIVE_HEADER.search(k)))
        if headers.get("last-modified"):
            R.highlight(f"🌐 Server date: {headers['last-modified']}")
    return R.row()


def file_section(R: Report, b: bytes, meta: dict, mime: str, total: int) -> None:
    s = R.section("file", "File")
    R.sections.insert(0, R.sections.pop(R.sections.index(s)))
    url, i = meta.get("url"), R.info
    s.add("Name", i["name"], False)
    s.add("URL", url if url and not re.match("data:|blob:", url) else None, False)
    s.add("Redirected URL", meta.get("final_url") if meta.get("final_url") != url else None, False)
    s.add("Source page", meta.get("referrer"), False)
    s.add("Size", f"{size_text(total)} ({total:,} bytes)", False)
    s.add("Detected type", i["type_label"], False)
    s.add("Content-Type", meta.get("content_type") if mime else None, False)
    s.add("Last modified (file system)", meta.get("last_modified"), True)
    if i.get("width"):
        w, h = i["width"], i.get("height") or 0
        s.add("Pixel dimensions", f"{w:g} × {h:g} ({w * h / 1e6:.1f} MP)", False)
    if native.mismatch(i["type"], mime, i["category"]):
        R.flag("mime-mismatch", "warn", f'Content type mismatch: the server says "{mime}", the file is {i["type_label"]}')
    if R.partial:
        parts = R.partial["parts"] or []
        read = sum(p["e"] - p["s"] for p in parts)
        s.add("Partial analysis", f"{size_text(read)} / {size_text(total)} read ({', '.join(f'{size_text(p["s"])}–{size_text(p["e"])}' for p in parts)})", False)
        R.warn(f"Large file: only the parts holding metadata were read ({size_text(read)}). Hashes were not computed.")
    else:
        s.add("SHA-256", hashlib.sha256(b).hexdigest(), False)
        s.add("SHA-1", hashlib.sha1(b).hexdigest(), False)


def extract(files: DataFrame) -> DataFrame:
    """REPORT rows of files. Columns of INPUT that files lacks are null, but content, which is needed; file_id falls back on path."""
    have = set(files.columns)
    own = files
    if "file_id" not in have:
        own = own.withColumn("file_id", F.col("path"))
    if "name" not in have:
        own = own.withColumn("name", native.name_from_url(F.coalesce(F.col("url") if "url" in have else F.lit(None), F.col("file_id"))))
    if "type" not in have:
        own = own.withColumn("type", native.sniff(F.col("content")))
    for c, kind in (("headers", "map<string,string>"), ("partial", "struct<total:bigint,parts:array<struct<s:bigint,e:bigint>>>"), ("via_background", "boolean")):
        if c not in have:
            own = own.withColumn(c, F.lit(None).cast(kind))
    own = own.select(*[F.col(c) if c in own.columns else F.lit(None).cast("string").alias(c) for c in INPUT])
    schema = to_arrow_schema(StructType.fromDDL(REPORT))
    parsers, types = dict(load()), dict(TYPES)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 8):  # few whole files are held at a time
                out = []
                for r in batch.slice(start, 8).to_pylist():
                    out.append({"file_id": r["file_id"], **analyse(r["content"], r, parsers, types)})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return own.mapInArrow(run, REPORT)


def metadata_rows(reports: DataFrame) -> DataFrame:
    """The long form: file_id, section_ord, section_id, section_title, row_ord, k, v, s."""
    s = reports.select("file_id", F.posexplode("sections").alias("section_ord", "section"))
    return s.select("file_id", "section_ord", F.col("section.id").alias("section_id"), F.col("section.title").alias("section_title"), F.posexplode("section.rows").alias("row_ord", "row")).select("file_id", "section_ord", "section_id", "section_title", "row_ord", "row.k", "row.v", "row.s")
