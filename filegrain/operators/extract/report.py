"""The report on one file: information, flags, highlights, warnings, position and sections of rows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Keys that are sensitive unless a caller says otherwise.
SENSITIVE = re.compile(r"serial|owner|artist|author|creator|gps|by-?line|contact|e-?mail|phone|address|user|software|document ?id|instance ?id|host|path|comment|unique", re.I)
LEVELS = {"danger": 100, "warn": 10, "info": 1}


@dataclass
class Section:
    id: str
    title: str
    rows: list[dict] = field(default_factory=list)

    def add(self, key: str, value, sensitive: bool | None = None) -> None:
        """Null and empty values are left out."""
        if value is None or value == "":
            return
        self.rows.append({"k": key, "v": str(value), "s": bool(SENSITIVE.search(key)) if sensitive is None else sensitive})


class Report:
    def __init__(self, depth: int = 0, partial: dict | None = None):
        self.depth, self.partial = depth, partial
        self.info: dict = {}
        self.flags: list[dict] = []
        self.highlights: list[str] = []
        self.warnings: list[str] = []
        self.gps: dict | None = None
        self.thumbnail: bytes | None = None
        self.sections: list[Section] = []

    def section(self, id: str, title: str) -> Section:
        for s in self.sections:
            if s.id == id:
                return s
        self.sections.append(Section(id, title))
        return self.sections[-1]

    def has(self, id: str) -> bool:
        return any(s.id == id and s.rows for s in self.sections)

    def flag(self, code: str, level: str, text: str) -> None:
        if not any(f["text"] == text for f in self.flags):
            self.flags.append({"code": code, "level": level, "text": text})

    def highlight(self, text: str) -> None:
        if text not in self.highlights:
            self.highlights.append(text)

    def warn(self, text: str) -> None:
        self.warnings.append(text)

    def position(self, lat: float, lon: float, alt: float | None = None, source: str | None = None) -> None:
        if not (-90 <= lat <= 90 and -180 <= lon <= 180):
            return
        if self.gps is None:
            self.gps = {"lat": lat, "lon": lon, "alt": alt, "source": source}
            self.highlight(f"📍 {lat:.5f}, {lon:.5f}")
        self.flag("gps", "danger", "Contains GPS location")

    def thumb(self, data: bytes) -> None:
        if self.thumbnail is None and data:
            self.thumbnail = bytes(data)

    def embed(self, sub: Report, label: str) -> bool:
        """Take over what an embedded file's report says; true if it says anything."""
        rows = [r for s in sub.sections for r in s.rows if s.id not in ("jpeg", "png", "gif", "webp", "bmp", "isobmff", "audio")]
        if not rows and not sub.gps:
            return False
        own = self.section(f"embedded-{len(self.sections)}", f"Embedded file · {label}")
        own.rows += rows
        for f in sub.flags:
            self.flag(f["code"], f["level"], f"In an embedded file: {f['text']}")
        if sub.gps:
            if self.gps is None:
                self.gps = {**sub.gps, "source": label}
            self.flag("embedded-gps", "danger", "Embedded images contain GPS location")
        return True

    def row(self) -> dict:
        i = self.info
        names = ("url", "name", "size", "type", "type_label", "category", "mime", "width", "height", "pages", "duration", "title", "encrypted")
        return {
            "info": {k: i.get(k) for k in names} | {"partial": self.partial is not None},
            "flags": self.flags,
            "highlights": self.highlights,
            "warnings": self.warnings,
            "gps": self.gps,
            "thumbnail": self.thumbnail,
            "sections": [{"id": s.id, "title": s.title, "rows": s.rows} for s in self.sections if s.rows],
        }
