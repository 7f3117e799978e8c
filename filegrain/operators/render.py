"""Reports as JSON, HTML, text and CSV lines, by expressions; sinks write them with Spark's text writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import native

BOM = "﻿"
CSV_HEADER = ("url", "type", "size", "gps_lat", "gps_lon", "warnings", "highlights", "error")
COLORS = {"danger": "#c92a2a", "warn": "#a35b00", "info": "#1f5fa8"}
#: Sections that a viewer shows folded. Fixed values.
COLLAPSED = ("http", "icc", "exif-ifd1", "exif-interop", "isobmff")


#: A page, cut where a report's own parts go.
PAGE = (
    '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>',
    "</title><style>body{font:14px sans-serif;max-width:960px;margin:24px auto}table{width:100%;border-collapse:collapse}td{border-top:1px solid #e6e6e3;padding:4px 8px;white-space:pre-wrap}tr.s td{background:#fff4d6}</style></head><body><h1>",
    '</h1><div class="sub">',
    " · ",
    "</div><p>",
    "</p>",
    "<footer>",
    " UTC · yellow rows may be sensitive</footer></body></html>",
)


def as_text(info="info", flags="flags", gps="gps", sections="sections") -> Column:
    i, g = F.col(info), F.col(gps)
    head = F.concat(F.coalesce(i["name"], F.lit("")), F.lit(" — "), F.coalesce(i["type_label"], F.lit("")))
    lines = F.transform(flags, lambda f: F.concat(F.lit("["), f["level"], F.lit("] "), f["text"]))
    place = F.when(g.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("GPS: "), g["lat"].cast("string"), F.lit(", "), g["lon"].cast("string"), F.when(g["alt"].isNull(), "").otherwise(F.concat(F.lit(" ("), g["alt"].cast("string"), F.lit(" m)"))))))
    rows = F.flatten(F.transform(sections, lambda s: F.concat(F.array(F.lit(""), F.concat(F.lit("## "), s["title"])), F.transform(s["rows"], lambda r: F.concat(r["k"], F.lit(": "), r["v"])))))
    return F.array_join(F.concat(F.array(head), lines, place, rows), "\n")


def as_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"pretty": "true"})


def as_html(at) -> Column:
    """A page without scripts; every value is escaped. at: the time it is made, as text."""
    e = native.escape_html
    i, g = F.col("info"), F.col("gps")
    color = F.create_map(*[F.lit(x) for kv in COLORS.items() for x in kv])
    chips = F.array_join(F.transform("flags", lambda f: F.concat(F.lit('<span class="flag" style="color:'), color[f["level"]], F.lit(";border-color:"), color[f["level"]], F.lit('">'), e(f["text"]), F.lit("</span>"))), "")
    map_ = F.when(g.isNull(), "").otherwise(F.concat(F.lit("<p><b>GPS:</b> "), g["lat"].cast("string"), F.lit(", "), g["lon"].cast("string"), F.lit("</p>")))
    row = lambda r: F.concat(F.lit("<tr"), F.when(r["s"], ' class="s"').otherwise(""), F.lit("><td>"), e(r["k"]), F.lit("</td><td>"), e(r["v"]), F.lit("</td></tr>"))
    tables = F.array_join(F.transform("sections", lambda s: F.concat(F.lit("<h2>"), e(s["title"]), F.lit("</h2><table>"), F.array_join(F.transform(s["rows"], row), ""), F.lit("</table>"))), "\n")
    picture = F.when(F.col("thumbnail").isNull(), "").otherwise(F.concat(F.lit('<p><img alt="embedded thumbnail" src="data:image/'), F.when(F.hex(F.substring("thumbnail", 1, 4)) == "89504E47", "png").otherwise("jpeg"), F.lit(";base64,"), F.base64("thumbnail"), F.lit('"></p>')))
    warnings = F.array_join(F.transform("warnings", lambda w: F.concat(F.lit('<p class="sub">⚠ '), e(w), F.lit("</p>"))), "")
    title = F.coalesce(i["title"], i["name"], F.lit("File"))
    parts = (PAGE[0], e(title), PAGE[1], e(title), PAGE[2], e(i["type_label"]), PAGE[3], native.size_text(i["size"]), PAGE[4], chips, PAGE[5], map_, picture, warnings, tables, PAGE[6], e(at), PAGE[7])
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def csv_line(columns) -> Column:
    return F.concat_ws(",", *[native.csv_quote(c) for c in columns])


def csv_lines(state: DataFrame, seq: str = "item_seq") -> DataFrame:
    """seq, line: a header with the byte order mark at -1, then a line for each row, in input order. state: url, info, flags, gps, highlights, error."""
    bar = lambda c: F.array_join(c, " | ")
    values = [F.col("url"), F.col("info.type_label"), F.col("info.size"), F.col("gps.lat"), F.col("gps.lon"), bar(F.transform("flags", lambda f: f["text"])), bar("highlights"), F.col("error")]
    head = state.sparkSession.range(1).select(F.lit(-1).cast("long").alias("seq"), F.concat(F.lit(BOM), csv_line([F.lit(h) for h in CSV_HEADER])).alias("line"))
    return head.unionByName(state.select(F.col(seq).cast("long").alias("seq"), csv_line(values).alias("line")))


def write_csv(state: DataFrame, path: str, seq: str = "item_seq") -> None:
    """CRLF lines in input order over range partitions: the part files in order are the export."""
    csv_lines(state, seq).orderBy("seq").select("line").write.option("lineSep", "\r\n").text(path)


def write_reports(reports: DataFrame, path: str, kind: str = "json") -> None:
    """One line (json), or one text field (text, html), for each report."""
    if kind == "json":
        reports.write.json(path)
        return
    made = as_text() if kind == "text" else as_html(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
    reports.select("file_id", made.alias("report")).write.parquet(path)


def write_cleaned(cleaned: DataFrame, names: DataFrame, path: str) -> None:
    """Cleaned bytes under the names that a user would save them by: file_id, name, bytes, type."""
    rows = cleaned.where("bytes IS NOT NULL").join(names.select("file_id", "name"), "file_id")
    rows.select("file_id", native.clean_name("name", F.col("ext")).alias("name"), "bytes", "type").write.partitionBy("type").parquet(path)


def collapsed(section_id) -> Column:
    return section_id.isin(*COLLAPSED)
