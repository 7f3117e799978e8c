"""Reading what holds a large file's metadata, through any source that has a size, its first bytes and ranges.

A source has head, size, ranged, whole (bytes, or None), read(s, e) and read_all().
"""

from __future__ import annotations

import re

from ..operators.extract.binary import be, latin, size_text
from ..operators.extract.detect import sniff
from ..operators.extract.isobmff import heif_items, meta_start
from .plan import FULL_LIMIT, HARD_LIMIT, HEAD, ISO_TYPES, MB, SPARSE_LIMIT, STILL_TYPES, WHOLE_TYPES, box_parts, end_parts, merged

PARTIAL = "struct<total:bigint,parts:array<struct<s:bigint,e:bigint>>>"


class FileSource:
    """A file that pyarrow's file systems open: local paths, and stores by their URIs."""

    ranged, whole = True, None

    def __init__(self, path: str):
        from pyarrow.fs import FileSystem

        system, at = FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
        self.file = system.open_input_file(at)
        self.size = self.file.size()
        self.head = self.read(0, min(HEAD, self.size))

    def read(self, s: int, e: int) -> bytes:
        self.file.seek(s)
        return self.file.read(e - s)

    def read_all(self) -> bytes:
        return self.read(0, self.size)


def top_boxes(source, size: int, most: int = 2000) -> list[tuple[str, int, int, int]]:
    """Top-level boxes by hopping from header to header."""
    out, at = [], 0
    while at + 8 <= size and len(out) < most:
        h = source.read(at, min(size, at + 16))
        n, head = be(h, 0, 4), 8
        if n == 1:
            n, head = be(h, 8, 8), 16
        elif n == 0:
            n = size - at
        if n < head:
            break
        out.append((latin(h[4:8]), at, min(size, at + n), head))
        at += n
    return out


class Pieces:
    """What has been read of a source: ranges, and their bytes at their places in the file."""

    def __init__(self, source):
        self.source, self.held = source, {}

    def take(self, parts: list[tuple[int, int]]) -> Pieces:
        for s, e in merged(parts, self.source.size):
            self.held[s, e] = self.source.read(s, e)
        return self

    @property
    def parts(self) -> list[tuple[int, int]]:
        return merged(list(self.held), self.source.size)

    def joined(self) -> bytes:
        """The bytes one after the other."""
        return b"".join(data for _, data in sorted(self.held.items()))

    def in_place(self) -> bytearray:
        """Bytes of the file's size, zero where nothing was read, so that offsets hold."""
        out = bytearray(self.source.size)
        for (s, e), data in self.held.items():
            out[s:e] = data
        return out


def _still(source) -> tuple[bytes, Pieces]:
    """Boxes of a still picture, then the metadata items to which they point."""
    boxes = top_boxes(source, source.size)
    found = Pieces(source).take(box_parts(boxes, headers=True))
    for name, s, e, head in boxes:
        if name == "meta":
            view = found.in_place()
            items = heif_items(view, meta_start(view, s + head), e)
            extents = (x for id, (kind, _) in items.types.items() if kind in ("Exif", "mime") for x in items.places.get(id, (1, []))[1])
            found.take([(at, at + n) for at, n in extents if n <= 16 * MB])
            break
    return bytes(found.in_place()), found


def load_source(source, full_limit: int = FULL_LIMIT, max_full: int = HARD_LIMIT) -> tuple[bytes, dict | None]:
    """Content, and which parts it holds if it isn't the whole file. Of large stills the content has the file's size."""
    size, kind = source.size, sniff(source.head)
    partly = source.whole is None and source.ranged and size and size > full_limit and kind is not None and kind not in WHOLE_TYPES
    if not partly:
        if size and size > max_full:
            raise ValueError(f"The file is too large ({size_text(size)}); partial analysis is not possible for this type")
        return source.read_all(), None
    if kind in STILL_TYPES and size <= SPARSE_LIMIT:
        content, found = _still(source)
    else:
        parts = box_parts(top_boxes(source, size), kind in STILL_TYPES) if kind in ISO_TYPES else end_parts(kind, size)
        found = Pieces(source).take(parts)
        content = found.joined()
    return content, {"total": size, "parts": [{"s": s, "e": e} for s, e in found.parts]}
