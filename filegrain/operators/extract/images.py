"""Raster images: JPEG, PNG, GIF, WebP, TIFF, BMP, ICO. Each format's walker yields parts; cleaning uses the same walkers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from . import parser
from .binary import be, counted, half_up, inflated, latin, le, number, signed, size_text, text
from .exif import emit_exif, emit_icc, emit_iptc, emit_xmp, read_tiff, resource_iptc
from .report import Report

#: Frame types by marker. Fixed values.
FRAMES = {0xC0: "Baseline DCT", 0xC1: "Extended DCT", 0xC2: "Progressive DCT", 0xC3: "Lossless", 0xC5: "Differential DCT", 0xC6: "Differential progressive", 0xC7: "Differential lossless", 0xC9: "Arithmetic extended", 0xCA: "Arithmetic progressive", 0xCB: "Arithmetic lossless"}
SAMPLING = {"2x2 1x1 1x1": "4:2:0", "2x1 1x1 1x1": "4:2:2", "1x1 1x1 1x1": "4:4:4"}
XMP_HEAD, XMP_MORE = b"http://ns.adobe.com/xap/1.0/\0", b"http://ns.adobe.com/xmp/extension/\0"
COLORS = {0: "Grayscale", 2: "RGB", 3: "Indexed", 4: "Grayscale + alpha", 6: "RGBA"}
GENERATED = re.compile("(parameters|prompt|workflow|Dream|sd-metadata|invokeai_metadata|generation_data)", re.I)


class Part(NamedTuple):
    kind: str | int
    start: int
    body: int
    end: int


#: In a scan's data a marker byte is followed by zero, or numbers a restart.
SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S)
SCAN, END = 0xDA, 0xD9
#: Markers without a length.
ALONE = (1, 0xD8, *range(0xD0, 0xD8))


def jpeg_parts(b: bytes, most: int = 5000, scans: bool = False) -> Iterator[Part]:
    """Marker segments; kind is the marker. They end at the first scan, or with scans=True at the image's end: a scan's part has its data then."""
    at = 2
    for _ in range(most):
        while b[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 2 > len(b) or b[at] != 0xFF:
            return
        marker = b[at + 1]
        if marker in (SCAN, END) and not scans:
            return
        size = 0 if marker in (*ALONE, END) else be(b, at + 2, 2)
        end = at + 2 + size
        if end > len(b) or marker not in (*ALONE, END) and size < 2:
            return
        if marker == SCAN:
            m = SCAN_END.search(b, end)
            end = m.start() if m else len(b)
        if scans or marker not in ALONE:
            yield Part(marker, at, min(at + 4, end), end)
        if marker == END:
            return
        at = end


def segment_kind(marker: int, body: bytes) -> str:
    """What a JPEG segment is, by its marker and signature."""
    heads = {(0xE0, b"JFIF\0"): "jfif", (0xE0, b"JFXX\0"): "jfxx", (0xE1, b"Exif\0\0"): "exif", (0xE1, XMP_HEAD): "xmp", (0xE1, XMP_MORE): "xmp-more", (0xE2, b"ICC_PROFILE\0"): "icc", (0xE2, b"MPF\0"): "mpf", (0xED, b"Photoshop 3.0\0"): "photoshop", (0xEE, b"Adobe"): "adobe", (0xEB, b"JP"): "jumbf"}
    for (m, head), kind in heads.items():
        if m == marker and body.startswith(head):
            return kind
    if marker == 0xFE:
        return "comment"
    if marker in FRAMES:
        return "frame"
    return {0xDB: "DQT", 0xC4: "DHT", 0xDD: "DRI"}.get(marker, "app" if 0xE0 <= marker <= 0xEF else "other")


@parser("jpeg")
def jpeg(b: bytes, R: Report) -> None:
    s, profile, labels = R.section("jpeg", "JPEG structure"), [], []
    known = {"jfif": "APP0 JFIF", "exif": "APP1 Exif", "xmp": "APP1 XMP", "xmp-more": "APP1 Extended XMP", "icc": "APP2 ICC", "mpf": "APP2 MPF", "photoshop": "APP13 Photoshop/IPTC", "adobe": "APP14 Adobe", "jumbf": "APP11 JUMBF", "comment": "COM"}
    for p in jpeg_parts(b):
        body = b[p.body : p.end]
        kind = segment_kind(p.kind, body)
        label = known.get(kind, kind if kind.isupper() else f"0x{p.kind:X}")
        if kind == "jfif" and len(body) > 11:
            s.add("JFIF version", f"{body[5]}.{body[6]:02d}")
            s.add("Density", f"{be(body, 8, 2)} × {be(body, 10, 2)} {('(aspect ratio)', 'dpi', 'dpcm', '')[min(body[7], 3)]}")
        elif kind == "exif":
            if t := read_tiff(b, p.body + 6, p.end):
                emit_exif(R, t)
        elif kind == "xmp":
            emit_xmp(R, text(body[len(XMP_HEAD) :]))
        elif kind == "icc":
            profile.append(body[14:])
        elif kind == "mpf":
            R.flag("mpf", "info", "Multi-picture (MPF) — may contain additional embedded images")
        elif kind == "photoshop":
            if block := resource_iptc(body[14:]):
                emit_iptc(R, block)
        elif kind == "jumbf":
            R.flag("c2pa", "info", "Contains a C2PA / content credentials (JUMBF) block")
        elif kind == "comment":
            s.add("Comment (COM)", text(body), True)
        elif kind == "frame" and len(body) >= 6:
            label = f"SOF {FRAMES[p.kind]}"
            R.info["height"], R.info["width"] = be(body, 1, 2), be(body, 3, 2)
            s.add("Encoding", FRAMES[p.kind])
            s.add("Bit depth / Components", f"{body[0]} bit, {body[5]} components")
            if body[5] == 3 and len(body) >= 15:
                factors = " ".join(f"{body[i] >> 4}x{body[i] & 15}" for i in (7, 10, 13))
                s.add("Chroma subsampling", SAMPLING.get(factors, factors))
        elif kind == "app":
            name = re.sub(r"[^\x20-\x7e]", "", latin(body[:32].split(b"\0", 1)[0]))
            label = f"APP{p.kind - 0xE0}{' ' + name if name else ''}"
        labels.append(label)
    if profile:
        emit_icc(R, b"".join(profile))
    s.add("Segments", counted(labels), False)
    end = b.rfind(b"\xff\xd9", max(0, len(b) - (32 << 20)))
    extra = len(b) - end - 2
    if not R.partial and end >= 0 and extra > 16:
        s.add("Data after EOI", size_text(extra), True)
        R.flag("trailing", "warn", f"{size_text(extra)} of trailing data (may be hidden content / an extra image)")


def png_parts(b: bytes, most: int = 100_000) -> Iterator[Part]:
    """Chunks, the end of each with its checksum; a chunk that is cut off is not among them."""
    at = 8
    for _ in range(most):
        if at + 12 > len(b):
            return
        end = at + 12 + be(b, at, 4)
        if end > len(b):
            return
        kind = latin(b[at + 4 : at + 8])
        yield Part(kind, at, at + 8, end)
        if kind == "IEND":
            return
        at = end


def _png_text(R: Report, key: str, value: str) -> None:
    if key == "XML:com.adobe.xmp":
        emit_xmp(R, value)
        return
    if m := re.fullmatch("Raw profile type (exif|APP1|iptc|xmp|8bim)", key, re.I):
        raw = bytes.fromhex((h := re.sub("[^0-9a-f]", "", "".join(value.strip().split("\n")[2:]), flags=re.I))[: len(h) & ~1])
        kind = m[1].lower()
        if kind in ("exif", "app1"):
            if t := read_tiff(raw, 6 if raw.startswith(b"Exif\0\0") else 0):
                emit_exif(R, t)
        elif kind == "xmp":
            emit_xmp(R, text(raw))
        elif block := raw if kind == "iptc" else resource_iptc(raw):
            emit_iptc(R, block)
        return
    if GENERATED.fullmatch(key):
        R.flag("generated", "info", "Contains AI generation parameters (Stable Diffusion/ComfyUI etc.)")
    R.section("png-text", "PNG text chunks").add(key, value, True)


@parser("png")
def png(b: bytes, R: Report) -> None:
    s, kinds, end = R.section("png", "PNG structure"), [], 0
    for p in png_parts(b):
        d, end = b[p.body : p.end - 4], p.end
        kinds.append(p.kind)
        try:
            if p.kind == "IHDR":
                R.info["width"], R.info["height"] = be(d, 0, 4), be(d, 4, 4)
                s.add("Color type", COLORS.get(d[9], d[9]))
                s.add("Bit depth", d[8])
                s.add("Interlace", "Adam7" if d[12] else "None")
            elif p.kind in ("tEXt", "zTXt"):
                key, _, value = d.partition(b"\0")
                _png_text(R, latin(key), latin(value if p.kind == "tEXt" else inflated(value[1:])))
            elif p.kind == "iTXt":
                key, _, rest = d.partition(b"\0")
                _, _, rest_text = rest[2:].partition(b"\0")
                body = rest_text.partition(b"\0")[2]
                _png_text(R, latin(key), text(inflated(body) if rest[:1] == b"\1" else body))
            elif p.kind == "eXIf":
                if t := read_tiff(d, 6 if d.startswith(b"Exif\0\0") else 0):
                    emit_exif(R, t)
            elif p.kind == "pHYs":
                x, y = be(d, 0, 4), be(d, 4, 4)
                s.add("Physical resolution", f"{half_up(x * 0.0254)} × {half_up(y * 0.0254)} dpi" if d[8] == 1 else f"{x}:{y} (no unit)")
            elif p.kind == "tIME":
                s.add("Last modified (tIME)", f"{be(d, 0, 2)}-{d[2]:02d}-{d[3]:02d} {d[4]:02d}:{d[5]:02d}:{d[6]:02d} UTC", True)
            elif p.kind == "iCCP":
                name, _, rest = d.partition(b"\0")
                emit_icc(R, inflated(rest[1:]), latin(name))
            elif p.kind == "sRGB":
                s.add("sRGB", dict(enumerate(("Perceptual", "Relative colorimetric", "Saturation", "Absolute colorimetric"))).get(d[0], d[0]))
            elif p.kind == "gAMA":
                s.add("Gamma", number(be(d, 0, 4) / 100000))
            elif p.kind == "acTL":
                s.add("Animation (APNG)", f"{be(d, 0, 4)} frames, {be(d, 4, 4) or 'infinite'} loops")
            elif p.kind in ("caBX", "jumb"):
                R.flag("c2pa", "info", "Contains a C2PA / content credentials (JUMBF) block")
        except (IndexError, ValueError) as e:
            R.warn(f"Could not read the {p.kind} chunk: {e}")
    s.add("Chunks", counted(kinds), False)
    if R.partial:
        return
    if not kinds or kinds[-1] != "IEND":
        if end and end + 12 <= len(b):
            R.warn(f"PNG chunk truncated: {latin(b[end + 4 : end + 8])}")
    elif len(b) - end > 4:
        s.add("Data after IEND", size_text(len(b) - end), True)
        R.flag("trailing", "warn", f"{size_text(len(b) - end)} of trailing data (may be hidden content)")


def _sub_blocks(b: bytes, at: int) -> int:
    while at < len(b) and b[at]:
        at += b[at] + 1
    return min(at + 1, len(b))


def gif_parts(b: bytes, most: int = 500_000) -> Iterator[Part]:
    """header, comment, app, ext, image, trailer; ends early (without a trailer) where the structure breaks."""
    if len(b) < 13:
        return
    at = 13 + (3 << (b[10] & 7) + 1 if b[10] & 128 else 0)
    yield Part("header", 0, 13, at)
    for _ in range(most):
        if at >= len(b):
            return
        start, lead = at, b[at]
        if lead == 0x3B:
            yield Part("trailer", at, at + 1, at + 1)
            return
        if lead == 0x21 and at + 1 < len(b):
            at = _sub_blocks(b, start + 2)
            yield Part({0xFE: "comment", 0xFF: "app"}.get(b[start + 1], "ext"), start, start + 2, at)
        elif lead == 0x2C and at + 9 < len(b):
            flags = b[at + 9]
            at = _sub_blocks(b, at + 11 + (3 << (flags & 7) + 1 if flags & 128 else 0))
            yield Part("image", start, start + 10, at)
        else:
            return


def gif_app(b: bytes, p: Part) -> str:
    return latin(b[p.body + 1 : p.body + 12])


@parser("gif")
def gif(b: bytes, R: Report) -> None:
    s, parts = R.section("gif", "GIF structure"), list(gif_parts(b))
    s.add("Version", latin(b[:6]))
    R.info["width"], R.info["height"] = le(b, 6, 2), le(b, 8, 2)
    s.add("Frame count", sum(p.kind == "image" for p in parts))
    apps = [(gif_app(b, p), p) for p in parts if p.kind == "app"]
    for name, p in apps:
        if name == "NETSCAPE2.0":
            s.add("Loop", le(b, p.body + 14, 2) or "Infinite")
    s.add("Application extensions", ", ".join(dict.fromkeys(name for name, _ in apps)), False)
    for p in parts:
        if p.kind == "comment":
            out, at = b"", p.body
            while at < p.end and b[at]:
                out += b[at + 1 : at + 1 + b[at]]
                at += b[at] + 1
            s.add("Comment", latin(out), True)


def riff_parts(b: bytes, start: int, end: int, most: int = 100_000) -> Iterator[Part]:
    """Chunks of a RIFF list; end is that of the body, without the padding byte."""
    at = start
    for _ in range(most):
        if at + 8 > end:
            return
        size = le(b, at + 4, 4)
        yield Part(latin(b[at : at + 4]), at, at + 8, min(end, at + 8 + size))
        at += 8 + size + (size & 1)


@parser("webp")
def webp(b: bytes, R: Report) -> None:
    s, kinds, frames = R.section("webp", "WebP structure"), [], 0
    for p in riff_parts(b, 12, len(b)):
        d, extended = b[p.body : p.end], "VP8X" in kinds
        if le(b, p.start + 4, 4) > len(d):
            break
        kinds.append(p.kind.strip())
        if p.kind == "VP8X":
            R.info["width"], R.info["height"] = 1 + le(d, 4, 3), 1 + le(d, 7, 3)
            features = [name for bit, name in ((32, "ICC"), (16, "Alpha"), (8, "EXIF"), (4, "XMP"), (2, "Animation")) if d[:1] and d[0] & bit]
            s.add("Features", ", ".join(features) or "—")
        elif p.kind == "VP8 ":
            if not extended:
                R.info["width"], R.info["height"] = le(d, 6, 2) & 0x3FFF, le(d, 8, 2) & 0x3FFF
            s.add("Compression", "Lossy (VP8)")
        elif p.kind == "VP8L":
            if not extended:
                bits = le(d, 1, 4)
                R.info["width"], R.info["height"] = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
            s.add("Compression", "Lossless (VP8L)")
        elif p.kind == "EXIF":
            if t := read_tiff(d, 6 if d.startswith(b"Exif\0\0") else 0):
                emit_exif(R, t)
        elif p.kind == "XMP ":
            emit_xmp(R, text(d))
        elif p.kind == "ICCP":
            emit_icc(R, d)
        elif p.kind == "ANMF":
            frames += 1
        elif p.kind == "ANIM":
            s.add("Loop", le(d, 4, 2) or "Infinite")
    s.add("Frame count", frames or None)
    s.add("Chunks", ", ".join(dict.fromkeys(kinds)), False)


@parser("tiff")
def tiff(b: bytes, R: Report) -> None:
    if t := read_tiff(b):
        emit_exif(R, t, "TIFF")


@parser("bmp")
def bmp(b: bytes, R: Report) -> None:
    s = R.section("bmp", "BMP structure")
    R.info["width"], R.info["height"] = signed(le(b, 18, 4), 32), abs(signed(le(b, 22, 4), 32))
    s.add("Header size", f"{le(b, 14, 4)} bytes")
    s.add("Bits/pixel", le(b, 28, 2))
    s.add("Compression", dict(enumerate(("None (BI_RGB)", "RLE8", "RLE4", "BITFIELDS", "JPEG", "PNG"))).get(le(b, 30, 4), le(b, 30, 4)))
    if density := signed(le(b, 38, 4), 32):
        s.add("Resolution", f"{half_up(density * 0.0254)} dpi")


@parser("ico")
def ico(b: bytes, R: Report) -> None:
    s, n = R.section("ico", "ICO structure"), le(b, 4, 2)
    s.add("Image count", n)
    s.add("Sizes", ", ".join(f"{b[p] or 256}×{b[p + 1] or 256}" for p in range(6, 6 + 16 * min(n, 64), 16) if p + 1 < len(b)))
