"""EBML: Matroska and WebM."""

from __future__ import annotations

import struct

from . import parser
from .audio import notice, tags, took
from .binary import number, seconds_since, signed, text
from .report import Report

#: Element ids: name and kind (master, skip, unsigned, float, date, string, bytes). Fixed values.
ELEMENTS = {0x1A45DFA3: ("EBML", "m"), 0x18538067: ("Segment", "m"), 0x1549A966: ("Info", "m"), 0x1654AE6B: ("Tracks", "m"), 0xAE: ("TrackEntry", "m"), 0xE0: ("Video", "m"), 0xE1: ("Audio", "m"), 0x1254C367: ("Tags", "m"), 0x7373: ("Tag", "m"), 0x67C8: ("SimpleTag", "m"), 0x1941A469: ("Attachments", "m"), 0x61A7: ("AttachedFile", "m"), 0x1043A770: ("Chapters", "m"), 0x45B9: ("EditionEntry", "m"), 0xB6: ("ChapterAtom", "m"), 0x80: ("ChapterDisplay", "m"), 0x1F43B675: ("Cluster", "x"), 0x1C53BB6B: ("Cues", "x"), 0x114D9B74: ("SeekHead", "x"), 0x4282: ("DocType", "s"), 0x2AD7B1: ("TimecodeScale", "u"), 0x4489: ("Duration", "f"), 0x4461: ("DateUTC", "d"), 0x7BA9: ("Title", "s"), 0x4D80: ("MuxingApp", "s"), 0x5741: ("WritingApp", "s"), 0x73A4: ("SegmentUID", "b"), 0xD7: ("TrackNumber", "u"), 0x83: ("TrackType", "u"), 0x86: ("CodecID", "s"), 0x536E: ("Name", "s"), 0x22B59C: ("Language", "s"), 0xB0: ("PixelWidth", "u"), 0xBA: ("PixelHeight", "u"), 0xB5: ("SamplingFrequency", "f"), 0x9F: ("Channels", "u"), 0x45A3: ("TagName", "s"), 0x4487: ("TagString", "s"), 0x466E: ("FileName", "s"), 0x4660: ("FileMimeType", "s"), 0x467E: ("FileDescription", "s"), 0x85: ("ChapString", "s")}
TRACKS = {1: "Video", 2: "Audio", 3: "Complex", 16: "Logo", 17: "Subtitles", 18: "Buttons", 33: "Control"}


def vint(b: bytes, at: int, marker: bool) -> tuple[int, int, bool] | None:
    """Value, length and whether it stands for an unknown size; the length marker stays in ids."""
    if at >= len(b) or not b[at]:
        return None
    n = 9 - b[at].bit_length()
    raw = int.from_bytes(b[at : at + n].ljust(n, b"\0"), "big")
    value = raw & (1 << 7 * n) - 1
    return raw if marker else value, n, not marker and value == (1 << 7 * n) - 1


def value(kind: str, d: bytes):
    if kind == "u":
        return int.from_bytes(d, "big")
    if kind == "f":
        return struct.unpack(">f" if len(d) == 4 else ">d", d)[0] if len(d) in (4, 8) else 0.0
    if kind == "d":
        return seconds_since(2001, signed(int.from_bytes(d, "big"), 8 * len(d)) // 1_000_000_000) if d else None
    return d[:16].hex() if kind == "b" else text(d).rstrip("\0")


def elements(b: bytes, start: int, end: int, depth: int = 0, left: list[int] | None = None):
    """(name, kind, value or None, depth) in order; a master comes before and after its children."""
    left = [200_000] if left is None else left
    at = start
    while at < end and left[0] > 0:
        left[0] -= 1
        id, size = vint(b, at, True), None
        if id:
            size = vint(b, at + id[1], False)
        if not size:
            return
        body = at + id[1] + size[1]
        stop = end if size[2] else min(end, body + size[0])
        name, kind = ELEMENTS.get(id[0], (None, None))
        if kind == "m":
            yield name, "open", None, depth
            if depth < 8:
                yield from elements(b, body, stop, depth + 1, left)
            yield name, "close", None, depth
        elif size[2]:
            return
        elif name and kind != "x":
            yield name, kind, value(kind, bytes(b[body:stop])), depth
        at = stop


@parser("mkv")
def matroska(b: bytes, R: Report) -> None:
    s, t, rows = R.section("mkv", "Container (Matroska)"), tags(R), R.section("media-tracks", "Tracks")
    one: dict = {"TimecodeScale": 1_000_000, "DocType": "matroska"}
    tracks: list[dict] = []
    attached: dict | None = None
    name_of_tag = None
    for name, kind, v, _ in elements(b, 0, len(b)):
        if name == "TrackEntry" and kind == "open":
            tracks.append({})
        elif name == "AttachedFile":
            if kind == "close" and attached is not None:
                about = f"{attached.get('FileMimeType', '')} {attached.get('FileDescription', '')}".strip()
                t.add(f"Attachment: {attached.get('FileName', '?')}", about or "—", True)
                R.flag("attachment", "warn", "Matroska contains attachments")
            attached = {} if kind == "open" else None
        elif kind in ("open", "close"):
            continue
        elif name in ("DocType", "TimecodeScale", "Duration"):
            one[name] = v
        elif name == "DateUTC" and v:
            s.add("Creation time (DateUTC)", v, True)
            R.highlight(f"🕒 {v}")
        elif name == "Title":
            s.add("Title", v)
            R.info["title"] = v
        elif name in ("MuxingApp", "WritingApp", "SegmentUID"):
            s.add("Segment UID" if name == "SegmentUID" else name, v, True)
            if name == "WritingApp":
                R.highlight(f"🛠 {v}")
        elif name == "TagName":
            name_of_tag = v
        elif name == "TagString" and name_of_tag:
            t.add(name_of_tag, v)
            notice(R, name_of_tag.lower(), v)
            name_of_tag = None
        elif name == "ChapString":
            t.add("Chapter", v, False)
        elif attached is not None:
            attached[name] = v
        elif tracks:
            tracks[-1].setdefault(name, v)
    R.info["type_label"] = "WebM" if one["DocType"] == "webm" else "MKV"
    s.add("DocType", one["DocType"])
    if one.get("Duration"):
        took(R, s, one["Duration"] * one["TimecodeScale"] / 1e9)
    for i, x in enumerate(tracks, 1):
        if x.get("PixelWidth") and not R.info.get("width"):
            R.info["width"], R.info["height"] = x["PixelWidth"], x.get("PixelHeight")
        parts = [TRACKS.get(x.get("TrackType"), "?"), x.get("CodecID"), f"{x['PixelWidth']}×{x.get('PixelHeight')}" if x.get("PixelWidth") else None, f"{x['Channels']} channels" if x.get("Channels") else None, f"{number(x['SamplingFrequency'])} Hz" if x.get("SamplingFrequency") else None, x.get("Language"), f"“{x['Name']}”" if x.get("Name") else None]
        rows.add(f"Track {i}", " · ".join(p for p in parts if p), False)
