"""EXIF (TIFF directories), XMP, IPTC and ICC, by their public specifications."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field
from xml.etree import ElementTree

from .binary import be, entities, latin, number, text, until_nul
from .report import Report

#: Names of tags by directory. Fixed values of the EXIF specification.
IMAGE = {0x10E: "ImageDescription", 0x10F: "Make", 0x110: "Model", 0x100: "ImageWidth", 0x101: "ImageHeight", 0x102: "BitsPerSample", 0x103: "Compression", 0x112: "Orientation", 0x11A: "XResolution", 0x11B: "YResolution", 0x128: "ResolutionUnit", 0x131: "Software", 0x132: "DateTime", 0x13B: "Artist", 0x13C: "HostComputer", 0x8298: "Copyright", 0x9C9B: "XPTitle", 0x9C9C: "XPComment", 0x9C9D: "XPAuthor", 0x9C9E: "XPKeywords", 0x9C9F: "XPSubject", 0xC62F: "CameraSerialNumber"}
CAPTURE = {0x829A: "ExposureTime", 0x829D: "FNumber", 0x8822: "ExposureProgram", 0x8827: "ISO", 0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9010: "OffsetTime", 0x9011: "OffsetTimeOriginal", 0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9204: "ExposureBiasValue", 0x9207: "MeteringMode", 0x9208: "LightSource", 0x9209: "Flash", 0x920A: "FocalLength", 0x927C: "MakerNote", 0x9286: "UserComment", 0x9290: "SubSecTime", 0x9291: "SubSecTimeOriginal", 0xA001: "ColorSpace", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension", 0xA217: "SensingMethod", 0xA300: "FileSource", 0xA301: "SceneType", 0xA401: "CustomRendered", 0xA402: "ExposureMode", 0xA403: "WhiteBalance", 0xA404: "DigitalZoomRatio", 0xA405: "FocalLengthIn35mmFilm", 0xA406: "SceneCaptureType", 0xA420: "ImageUniqueID", 0xA430: "CameraOwnerName", 0xA431: "SerialNumber", 0xA432: "LensInfo", 0xA433: "LensMake", 0xA434: "LensModel", 0xA435: "LensSerialNumber"}
GPS = {0: "GPSVersionID", 1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp", 12: "GPSSpeedRef", 13: "GPSSpeed", 16: "GPSImgDirectionRef", 17: "GPSImgDirection", 18: "GPSMapDatum", 27: "GPSProcessingMethod", 28: "GPSAreaInformation", 29: "GPSDateStamp"}
ENUMS = {
    "Orientation": {1: "Normal", 2: "Mirrored horizontally", 3: "Rotated 180°", 4: "Mirrored vertically", 5: "Mirrored + 270° CW", 6: "Rotated 90° CW", 7: "Mirrored + 90° CW", 8: "Rotated 270° CW"},
    "ResolutionUnit": {1: "None", 2: "inches", 3: "cm"},
    "Compression": {1: "Uncompressed", 2: "CCITT", 5: "LZW", 6: "JPEG (old-style)", 7: "JPEG", 8: "Deflate", 32773: "PackBits"},
    "ExposureProgram": {0: "Undefined", 1: "Manual", 2: "Program AE", 3: "Aperture priority", 4: "Shutter priority", 5: "Creative", 6: "Action", 7: "Portrait", 8: "Landscape"},
    "MeteringMode": {0: "Unknown", 1: "Average", 2: "Center-weighted", 3: "Spot", 4: "Multi-spot", 5: "Multi-segment", 6: "Partial"},
    "LightSource": {0: "Unknown", 1: "Daylight", 2: "Fluorescent", 3: "Tungsten", 4: "Flash", 9: "Fine weather", 10: "Cloudy", 11: "Shade"},
    "ColorSpace": {1: "sRGB", 2: "Adobe RGB", 65535: "Uncalibrated"},
    "SensingMethod": {2: "One-chip color area sensor", 3: "Two-chip", 4: "Three-chip", 5: "Color sequential area", 8: "Color sequential linear"},
    "CustomRendered": {0: "Normal", 1: "Custom process"},
    "ExposureMode": {0: "Auto", 1: "Manual", 2: "Auto bracket"},
    "WhiteBalance": {0: "Auto", 1: "Manual"},
    "SceneCaptureType": {0: "Standard", 1: "Landscape", 2: "Portrait", 3: "Night"},
    "FileSource": {3: "Digital camera"},
    "SceneType": {1: "Directly photographed"},
    "GPSAltitudeRef": {0: "Above sea level", 1: "Below sea level"},
    "GPSSpeedRef": {"K": "km/h", "M": "mph", "N": "knots"},
}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


@dataclass
class Tiff:
    order: str
    image: dict = field(default_factory=dict)
    capture: dict = field(default_factory=dict)
    gps: dict = field(default_factory=dict)
    interop: dict = field(default_factory=dict)
    thumbnail: dict = field(default_factory=dict)
    preview: bytes | None = None


def read_tiff(b: bytes, start: int = 0, end: int | None = None) -> Tiff | None:
    """Directories of a TIFF block: tag -> value. Offsets that lead nowhere are left out."""
    data = bytes(b[start : len(b) if end is None else end])
    if data[:4] not in (b"II*\0", b"MM\0*"):
        return None
    order = "<" if data[:2] == b"II" else ">"
    number_at = lambda at, kind: struct.unpack_from(order + kind, data, at)[0]
    seen: set[int] = set()

    def value(kind: int, n: int, at: int):
        size = SIZES[kind] * n
        place = at + 8 if size <= 4 else number_at(at + 8, "I")
        raw = data[place : place + size]
        if len(raw) < size:
            return None
        if kind == 2:
            return text(raw.split(b"\0", 1)[0]).strip()
        if kind == 7:
            return raw
        if kind in (5, 10):
            pairs = struct.unpack(order + ("II" if kind == 5 else "ii") * n, raw)
            out = tuple((p / q if q else 0.0) for p, q in zip(pairs[::2], pairs[1::2], strict=True))
        else:
            out = struct.unpack(order + CODES[kind] * n, raw)
        return out[0] if n == 1 else out

    def directory(at: int) -> tuple[dict, int]:
        out: dict = {}
        if at in seen or at < 8 or at + 2 > len(data):
            return out, 0
        seen.add(at)
        n = number_at(at, "H")
        for i in range(min(n, 1000)):
            p = at + 2 + 12 * i
            if p + 12 > len(data):
                return out, 0
            tag, kind, count = struct.unpack_from(order + "HHI", data, p)
            if kind in SIZES and count and count * SIZES[kind] <= len(data):
                got = value(kind, count, p)
                if got is not None:
                    out[tag] = got
        after = at + 2 + 12 * n
        return out, number_at(after, "I") if after + 4 <= len(data) else 0

    try:
        t = Tiff(order)
        t.image, following = directory(number_at(4, "I"))
        for tag, name in ((0x8769, "capture"), (0x8825, "gps")):
            if isinstance(t.image.get(tag), int):
                setattr(t, name, directory(t.image[tag])[0])
        if isinstance(t.capture.get(0xA005), int):
            t.interop = directory(t.capture[0xA005])[0]
        if following:
            t.thumbnail = directory(following)[0]
            a, n = t.thumbnail.get(0x201), t.thumbnail.get(0x202)
            if isinstance(a, int) and isinstance(n, int) and 0 < n and a + n <= len(data):
                t.preview = data[a : a + n]
        return t
    except struct.error:
        return None


def _shown(name: str, v) -> str | None:
    if name in ENUMS and isinstance(v, int | str) and v in ENUMS[name]:
        return ENUMS[name][v]
    if name == "Flash" and isinstance(v, int):
        return f"Flash fired ({v:#x})" if v & 1 else f"Flash did not fire ({v:#x})"
    if name == "MakerNote" and isinstance(v, bytes):
        return f"[{len(v)} bytes — vendor-specific MakerNote]"
    if name.startswith("XP"):
        raw = bytes(v) if isinstance(v, tuple) else v if isinstance(v, bytes) else b""
        return raw.decode("utf-16-le", "replace").rstrip("\0")
    if name in ("UserComment", "GPSProcessingMethod", "GPSAreaInformation") and isinstance(v, bytes):
        body = v[8:]
        return (body.decode("utf-16", "replace") if v.startswith(b"UNICODE") else text(body)).strip("\0 ")
    if name in ("ExposureTime", "ShutterSpeedValue") and isinstance(v, float) and name == "ExposureTime":
        return f"1/{round(1 / v)} s" if 0 < v < 0.5 else f"{number(v)} s"
    if name == "FNumber" and isinstance(v, float):
        return f"f/{number(v)}"
    if name == "FocalLength" and isinstance(v, float):
        return f"{number(v)} mm"
    if name in ("FileSource", "SceneType") and isinstance(v, bytes) and v:
        return ENUMS[name].get(v[0], str(v[0]))
    if isinstance(v, bytes):
        return latin(v) if re.fullmatch(rb"[\x20-\x7e]+", v) else f"[{len(v)} bytes]"
    if isinstance(v, tuple):
        return ", ".join(number(x) if isinstance(x, float) else str(x) for x in v)
    return number(v) if isinstance(v, float) else str(v)


def _degrees(v, ref) -> float | None:
    if not isinstance(v, tuple) or len(v) < 2:
        return None
    d = v[0] + v[1] / 60 + (v[2] / 3600 if len(v) > 2 else 0)
    return -d if str(ref).upper()[:1] in ("S", "W") else d


def emit_exif(R: Report, t: Tiff, label: str = "EXIF") -> None:
    for values, names, id, title in ((t.image, IMAGE, "exif-ifd0", f"{label} · Image"), (t.capture, CAPTURE, "exif-exif", f"{label} · Capture settings")):
        s = R.section(id, title)
        for tag, v in values.items():
            if tag in (0x8769, 0x8825, 0xA005):
                continue
            name = names.get(tag)
            if name or id == "exif-ifd0" and tag not in (0x111, 0x117, 0x144, 0x145):
                s.add(name or f"0x{tag:04X}", _shown(name or "", v))
    if t.interop:
        R.section("exif-interop", f"{label} · Interop").add("InteropIndex", _shown("", t.interop.get(1)) if t.interop.get(1) else None)
    if t.thumbnail:
        s = R.section("exif-ifd1", f"{label} · Embedded thumbnail")
        for tag, v in t.thumbnail.items():
            if tag in IMAGE:
                s.add(IMAGE[tag], _shown(IMAGE[tag], v))
        if t.preview:
            s.add("Thumbnail", f"[thumbnail {len(t.preview)} bytes]", True)
            R.thumb(t.preview)
    if isinstance(t.image.get(0x100), int) and not R.info.get("width") and label == "TIFF":
        R.info["width"], R.info["height"] = t.image[0x100], t.image.get(0x101)
    lat, lon = _degrees(t.gps.get(2), t.gps.get(1)), _degrees(t.gps.get(4), t.gps.get(3))
    if t.gps:
        s = R.section("exif-gps", "GPS location")
        for tag, v in t.gps.items():
            name = GPS.get(tag)
            shown = number(lat) if tag == 2 and lat is not None else number(lon) if tag == 4 and lon is not None else _shown(name or "", v)
            s.add(name or f"0x{tag:04X}", shown, True)
    if lat is not None and lon is not None:
        alt = t.gps.get(6)
        if isinstance(alt, float):
            alt = -alt if t.gps.get(5) in (1, b"\1") else alt
        R.position(round(lat, 6), round(lon, 6), alt if isinstance(alt, float) else None, label)
    device = " ".join(str(t.image[k]) for k in (0x10F, 0x110) if t.image.get(k))
    if device:
        R.highlight(f"📷 {device}")
        R.flag("device", "info", "Contains device make/model")
    if any(t.capture.get(k) for k in (0xA431, 0xA435)) or t.image.get(0xC62F):
        R.flag("serial", "warn", "Contains device/lens serial number")
    if t.image.get(0x13B) or t.capture.get(0xA430) or t.image.get(0x9C9D):
        R.flag("owner", "warn", "Contains owner / artist name")
    if t.image.get(0x131):
        R.highlight(f"🛠 {t.image[0x131]}")
    when = t.capture.get(0x9003) or t.image.get(0x132)
    if when:
        R.highlight(f"🕒 {when}")


# --- XMP

NAMES = {"http://purl.org/dc/elements/1.1/": "dc", "http://ns.adobe.com/xap/1.0/": "xmp", "http://ns.adobe.com/xap/1.0/mm/": "xmpMM", "http://ns.adobe.com/photoshop/1.0/": "photoshop", "http://ns.adobe.com/pdf/1.3/": "pdf", "http://ns.adobe.com/exif/1.0/": "exif", "http://ns.adobe.com/tiff/1.0/": "tiff", "http://ns.adobe.com/xap/1.0/rights/": "xmpRights", "http://ns.adobe.com/xap/1.0/sType/ResourceEvent#": "stEvt", "http://ns.adobe.com/xap/1.0/sType/ResourceRef#": "stRef", "http://iptc.org/std/Iptc4xmpCore/1.0/xmlns/": "Iptc4xmpCore", "http://ns.adobe.com/exif/1.0/aux/": "aux", "http://creativecommons.org/ns#": "cc"}
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
PACKET = re.compile(rb"<x:xmpmeta\b.*?</x:xmpmeta\s*>|<rdf:RDF\b.*?</rdf:RDF\s*>", re.S)


def find_xmp(b: bytes) -> str | None:
    m = PACKET.search(bytes(b))
    return text(m[0]) if m else None


def _plain(tag: str) -> str:
    if tag[0] != "{":
        return tag
    space, _, local = tag[1:].partition("}")
    return f"{NAMES.get(space, space.rstrip('/#').rpartition('/')[2])}:{local}"


def parse_xmp(xml: str) -> list[tuple[str, str]]:
    """(property, value) in order; lists are joined, nested structures joined by a slash. Without entity declarations."""
    m = PACKET.search(xml.encode())
    body = text(m[0]) if m else xml
    if "<!ENTITY" in body or "<!DOCTYPE" in body:
        return []
    spaces = dict(re.findall(r"xmlns:([\w.-]+)\s*=\s*[\"']([^\"']*)", xml))
    lacking = [f'xmlns:{p}="{u}"' for p, u in spaces.items() if not re.search(rf"xmlns:{re.escape(p)}\s*=", body)]
    for p in set(re.findall(r"[<\s/]([A-Za-z_][\w.-]*):[A-Za-z_]", body)) - set(spaces) - {"xml", "xmlns"}:
        lacking.append(f'xmlns:{p}="urn:{p}"')
    try:
        root = ElementTree.fromstring(re.sub(r"^(<[\w:]+)", lambda k: f"{k[1]} {' '.join(lacking)}", body, count=1))
    except ElementTree.ParseError:
        return []
    out: list[tuple[str, str]] = []

    def leaf(prefix: str, e) -> None:
        for k, v in e.attrib.items():
            if not k.startswith(f"{{{RDF}}}") and not k.endswith("}lang"):
                out.append((f"{prefix}/{_plain(k)}" if prefix else _plain(k), v))
        lists = [c for c in e if c.tag in (f"{{{RDF}}}{x}" for x in ("Seq", "Bag", "Alt"))]
        if lists:
            items = [i for c in lists for i in c]
            plain = [(i.text or "").strip() for i in items if not len(i) and (i.text or "").strip()]
            if plain:
                out.append((prefix, ", ".join(plain)))
            for n, i in enumerate(items, 1):
                if len(i) or any(not k.startswith(f"{{{RDF}}}") and not k.endswith("}lang") for k in i.attrib):
                    leaf(f"{prefix}[{n}]", i)
        elif len(e):
            for c in e:
                leaf(prefix if c.tag == f"{{{RDF}}}Description" else f"{prefix}/{_plain(c.tag)}" if prefix else _plain(c.tag), c)
        elif (e.text or "").strip():
            out.append((prefix, e.text.strip()))

    for d in root.iter(f"{{{RDF}}}Description"):
        if not any(k == d for k in out):
            leaf("", d)
            break
    rest = [d for d in root.iter(f"{{{RDF}}}RDF") for d in list(d)[1:] if d.tag == f"{{{RDF}}}Description"]
    for d in rest:
        leaf("", d)
    for rdf in root.iter(f"{{{RDF}}}RDF"):
        for e in rdf:
            if e.tag != f"{{{RDF}}}Description":
                leaf("", e)
    return out


def _coordinate(v: str) -> float | None:
    m = re.fullmatch(r"(\d+),(\d+(?:\.\d+)?)(?:,(\d+(?:\.\d+)?))?([NSEW])", v.strip())
    if not m:
        return None
    d = float(m[1]) + float(m[2]) / 60 + (float(m[3]) / 3600 if m[3] else 0)
    return -d if m[4] in "SW" else d


def emit_xmp(R: Report, xml: str, title: str = "XMP", id: str = "xmp") -> bool:
    rows = parse_xmp(xml)
    if not rows:
        return False
    s = R.section(id, title)
    for k, v in rows[:2000]:
        s.add(k, entities(v))
    by = dict(reversed(rows))
    if by.get("dc:creator") or by.get("xmpRights:Owner"):
        R.flag("owner", "warn", "Contains owner / artist name")
        R.highlight(f"👤 {by.get('dc:creator') or by['xmpRights:Owner']}")
    if by.get("xmp:CreatorTool"):
        R.highlight(f"🛠 {by['xmp:CreatorTool']}")
    if any(k.startswith("xmpMM:History") for k, _ in rows):
        R.flag("history", "warn", "Contains edit history (xmpMM:History)")
    if any(k.startswith(("xmpMM:DerivedFrom", "xmpMM:Ingredients")) for k, _ in rows):
        R.flag("derived", "info", "Contains source/derived document references (XMP)")
    if re.search("c2pa|contentauth", xml, re.I):
        R.flag("c2pa", "info", "Contains traces of C2PA / content credentials")
    lat, lon = _coordinate(by.get("exif:GPSLatitude", "")), _coordinate(by.get("exif:GPSLongitude", ""))
    if lat is not None and lon is not None:
        R.position(round(lat, 6), round(lon, 6), None, "XMP")
    return True


# --- IPTC and Photoshop

#: Record 2 of IPTC-IIM. Fixed values.
IPTC = {5: "ObjectName", 15: "Category", 25: "Keywords", 40: "SpecialInstructions", 55: "DateCreated", 60: "TimeCreated", 80: "By-line", 85: "By-lineTitle", 90: "City", 92: "Sub-location", 95: "Province-State", 101: "Country", 103: "OriginalTransmissionReference", 105: "Headline", 110: "Credit", 115: "Source", 116: "CopyrightNotice", 118: "Contact", 120: "Caption", 122: "Writer-Editor"}


def resource_iptc(b: bytes) -> bytes | None:
    """The IPTC block among Photoshop's image resources."""
    at = 0
    while at + 12 <= len(b) and b[at : at + 4] == b"8BIM":
        id = be(b, at + 4, 2)
        name = b[at + 6] + 1
        at += 6 + name + (name & 1)
        size = be(b, at, 4)
        if id == 0x0404:
            return b[at + 4 : at + 4 + size]
        at += 4 + size + (size & 1)
    return None


def emit_iptc(R: Report, b: bytes) -> None:
    s, at, values = R.section("iptc", "IPTC"), 0, {}
    while at + 5 <= len(b) and b[at] == 0x1C:
        record, id, size = b[at + 1], b[at + 2], be(b, at + 3, 2)
        if record == 2 and id in IPTC:
            values.setdefault(IPTC[id], []).append(text(b[at + 5 : at + 5 + size]))
        at += 5 + size
    for k, v in values.items():
        s.add(k, ", ".join(v))
    if values.keys() & {"By-line", "Contact", "Writer-Editor"}:
        R.flag("iptc-contact", "warn", "Contains IPTC author/contact info")


def emit_icc(R: Report, b: bytes, name: str | None = None) -> None:
    if len(b) < 128:
        return
    s = R.section("icc", "ICC color profile")
    s.add("Profile name (embedded)", name)
    for i in range(min(be(b, 128, 4), 100)):
        at = 132 + 12 * i
        place, size = be(b, at + 4, 4), be(b, at + 8, 4)
        raw = b[place : place + size]
        label = {b"desc": "Description", b"cprt": "Copyright", b"dmnd": "Device manufacturer", b"dmdd": "Device model"}.get(bytes(b[at : at + 4]))
        if not label:
            continue
        if raw[:4] == b"mluc" and len(raw) >= 28:
            n, p = be(raw, 20, 4), be(raw, 24, 4)
            s.add(label, raw[p : p + n].decode("utf-16-be", "replace").rstrip("\0"))
        elif raw[:4] == b"desc":
            s.add(label, until_nul(raw[12 : 12 + be(raw, 8, 4)]))
        elif raw[:4] == b"text":
            s.add(label, until_nul(raw[8:]))
    s.add("Class / Color space", f"{latin(b[12:16]).strip()} / {latin(b[16:20]).strip()}")
    s.add("Profile creator", latin(b[80:84]).strip("\0 "))
    if be(b, 24, 2):
        s.add("Profile date", "{:04d}-{:02d}-{:02d} {:02d}:{:02d}:{:02d}".format(*(be(b, 24 + 2 * i, 2) for i in range(6))))


