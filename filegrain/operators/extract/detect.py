"""Type detection of one file's head, for embedded files; whole tables use functions.native.sniff, which reads the same table of signatures."""

from __future__ import annotations

import re

from .binary import be, latin, synchsafe

#: type -> label, category, parser. Fixed values.
TYPES = {
    "jpeg": ("JPEG", "image", "jpeg"),
    "png": ("PNG", "image", "png"),
    "gif": ("GIF", "image", "gif"),
    "webp": ("WebP", "image", "webp"),
    "tiff": ("TIFF", "image", "tiff"),
    "heif": ("HEIF/HEIC", "image", "isobmff"),
    "avif": ("AVIF", "image", "isobmff"),
    "bmp": ("BMP", "image", "bmp"),
    "ico": ("ICO", "image", "ico"),
    "svg": ("SVG", "image", "svg"),
    "pdf": ("PDF", "pdf", "pdf"),
    "mp4": ("MP4", "media", "isobmff"),
    "mov": ("MOV (QuickTime)", "media", "isobmff"),
    "m4a": ("M4A", "media", "isobmff"),
    "3gp": ("3GP", "media", "isobmff"),
    "cr3": ("CR3 (Canon RAW)", "image", "isobmff"),
    "mp3": ("MP3", "media", "mp3"),
    "flac": ("FLAC", "media", "flac"),
    "ogg": ("OGG", "media", "ogg"),
    "wav": ("WAV", "media", "riff"),
    "avi": ("AVI", "media", "riff"),
    "mkv": ("MKV", "media", "mkv"),
    "zip": ("ZIP", "doc", "zip"),
    "ole": ("OLE", "doc", "ole"),
}
#: An MPEG audio header whose fields are all defined: sync, version and layer, bit rate and sample rate.
FRAME = r"\xff[\xe2-\xe7\xf2-\xf7\xfa-\xff][" + "".join(rf"\x{h:x}0-\x{h:x}b" for h in range(1, 15)) + "]."
BLANK = r"[ \t-\r\xa0]"
#: Types by what the start of a file looks like, as Latin-1 text: the first row whose pattern fits decides. Views: "head", the
#: first 8 KiB; "brands", what an ftyp box lists; "behind", what follows an ID3 tag. Java and Python read the patterns alike. The signatures are fixed values.
SIGNATURES = [
    ("jpeg", "head", r"\xff\xd8\xff."),
    ("png", "head", r"\x89PNG"),
    ("gif", "head", "GIF8"),
    ("webp", "head", "RIFF.{4}WEBP"),
    ("wav", "head", "RIFF.{4}WAVE"),
    ("avi", "head", "RIFF.{4}AVI[ X]"),
    ("tiff", "head", r"II\*\x00|MM\x00\*"),
    ("avif", "brands", "(?!isom|mp4|qt)(?=.*avi[fs])"),
    ("heif", "brands", "hei[cxms]|hevc|m[is]f1|(?=.*mif1)(?=.*hei[cx])"),
    ("m4a", "brands", "M4[ABP]"),
    ("mov", "brands", "qt  "),
    ("cr3", "brands", "crx "),
    ("3gp", "brands", "3g"),
    ("mp4", "brands", ""),
    ("mov", "head", r"(?!\x00{3}[\x00-\x07]).{4}(?:moov|mdat|wide|free|pnot|skip)"),
    ("flac", "head", "fLaC"),
    ("flac", "behind", "fLaC"),
    ("mp3", "head", "ID3."),
    ("ogg", "head", "OggS"),
    ("mkv", "head", r"\x1aE\xdf\xa3"),
    ("zip", "head", r"PK[\x03\x05][\x04\x06]"),
    ("ole", "head", r"\xd0\xcf\x11\xe0"),
    ("pdf", "head", ".{0,1019}%PDF-"),
    ("bmp", "head", r"BM(?![\x00-\x1a]\x00{3}).{25}"),
    ("svg", "head", r"(?i).{0,1019}<svg[\s>]"),
    ("svg", "head", rf"(?i)(?={BLANK}{{0,1019}}(?:<\?xml|<!--)).{{0,8187}}<svg[\s>]"),
    ("ico", "head", r"\x00\x00\x01\x00[^\x00]\x00"),
    ("mp3", "head", FRAME),
]
#: kbit/s by version-layer and index. Fixed values.
BITRATES = {
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}


#: Version and layer by their four bits in the second byte of a header.
KINDS = {v << 3 | (4 - layer) << 1: (version, layer) for v, version in ((3, 1), (2, 2), (0, 2.5)) for layer in (1, 2, 3)}
_FRAME = re.compile(b"(?s)" + FRAME.encode())
_SIGNATURES = [(kind, view, re.compile(f"(?s)(?:{pattern})") if not pattern.startswith("(?i)") else re.compile(f"(?si){pattern[4:]}")) for kind, view, pattern in SIGNATURES]


def mpeg_frame(b: bytes, at: int) -> dict | None:
    """Header of an MPEG audio frame with the frame's length, or None where fields are reserved.

    A frame holds samples / 8 * kbps * 1000 / hz bytes, in slots of four bytes in layer I and of one otherwise, and a padding slot.
    """
    if not _FRAME.match(b, at):
        return None
    version, layer = KINDS[b[at + 1] & 0x1E]
    old = version == 1
    samples = {1: 384, 2: 1152, 3: 1152 if old else 576}[layer]
    kbps, hz = BITRATES[(1, layer) if old else (2, min(layer, 2) * 2 - 1)][b[at + 2] >> 4], RATES[version][b[at + 2] >> 2 & 3]
    slot = 4 if layer == 1 else 1
    slots = samples * 125 * kbps // (hz * slot) + (b[at + 2] >> 1 & 1)
    return {"version": version, "layer": layer, "kbps": kbps, "hz": hz, "mode": b[at + 3] >> 6, "samples": samples, "length": slots * slot}


def sniff(b: bytes) -> str | None:
    """Type of a file by the table of signatures."""
    views = {"head": latin(b[:8192])}
    if b[4:8] == b"ftyp":
        views["brands"] = latin(b[8 : 8 + max(4, min(64, be(b, 0, 4) - 8))])
    if b[:3] == b"ID3":
        views["behind"] = latin(b[10 + synchsafe(b, 6) :][:4])
    return next((kind for kind, view, pattern in _SIGNATURES if view in views and pattern.match(views[view])), None)
