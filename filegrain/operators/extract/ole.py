"""Compound files (DOC, XLS, PPT, VSD, MSG): directory, property sets and mail properties, by their public specifications."""

from __future__ import annotations

import re
import struct
from datetime import UTC, datetime, timedelta

from . import parser
from .binary import date_text, latin, le, size_text, text, windows
from .office import RISKY
from .report import Report

END = 0xFFFFFFFE
SUMMARY = {2: "Title", 3: "Subject", 4: "Author", 5: "Keywords", 6: "Comments", 7: "Template", 8: "Last saved by", 9: "Revision", 10: "Total editing time", 11: "Last printed", 12: "Created", 13: "Last saved", 14: "Pages", 15: "Words", 16: "Characters", 17: "Thumbnail", 18: "Application", 19: "Security"}
DOCUMENT = {2: "Category", 3: "Presentation target", 4: "Bytes", 5: "Lines", 6: "Paragraphs", 7: "Slides", 8: "Notes", 9: "Hidden slides", 10: "Media clips", 14: "Manager", 15: "Company", 17: "Characters (with spaces)", 23: "Application version", 26: "Content type", 27: "Content status", 28: "Language", 29: "Document version"}
MAIL = {0x0037: "Subject", 0x0C1A: "Sender name", 0x0C1F: "Sender address", 0x5D01: "Sender SMTP", 0x0042: "Sent on behalf of", 0x0065: "Sender email", 0x0E04: "To", 0x0E03: "CC", 0x0E02: "BCC", 0x0070: "Conversation topic", 0x007D: "Internet headers", 0x3FFA: "Last modified by", 0x0E1D: "Normalized subject", 0x001A: "Message class", 0x1000: "Body (first 500 characters)"}


class Compound:
    """Streams of a compound file by path."""

    def __init__(self, b: bytes):
        self.b = b
        self.sector = 1 << min(le(b, 30, 2), 16)
        mini = 1 << min(le(b, 32, 2), 16)
        table, at = [le(b, 76 + 4 * i, 4) for i in range(109)], le(b, 68, 4)
        for _ in range(min(le(b, 72, 4), 10_000)):
            if at >= END - 1:
                break
            own = self.raw(at)
            table += [le(own, i, 4) for i in range(0, self.sector - 4, 4)]
            at = le(own, self.sector - 4, 4)
        self.fat = self.numbers(b"".join(self.raw(s) for s in table if s < END - 1))
        directory = self.chain(le(b, 48, 4))
        self.entries = [directory[i : i + 128] for i in range(0, len(directory) - 127, 128)]
        if not self.entries:
            raise ValueError("no directory")
        self.small = self.numbers(self.chain(le(b, 60, 4)))
        self.mini, self.mini_size = self.chain(le(self.entries[0], 116, 4)), mini
        self.least = le(b, 56, 4)
        self.paths: dict[str, int] = {}
        self.walk(le(self.entries[0], 76, 4), "", set())

    @staticmethod
    def numbers(b: bytes) -> tuple[int, ...]:
        return struct.unpack(f"<{len(b) // 4}I", b[: len(b) & ~3])

    def raw(self, n: int) -> bytes:
        return self.b[(n + 1) * self.sector : (n + 2) * self.sector]

    def chain(self, n: int) -> bytes:
        out, seen = [], set()
        while n < END - 1 and n not in seen and len(seen) < 1_000_000:
            seen.add(n)
            out.append(self.raw(n))
            n = self.fat[n] if n < len(self.fat) else END
        return b"".join(out)

    def walk(self, i: int, base: str, seen: set[int]) -> None:
        stack = [(i, base)]
        while stack:
            i, base = stack.pop()
            if i >= len(self.entries) or i in seen:
                continue
            seen.add(i)
            e = self.entries[i]
            name = e[: max(0, min(64, le(e, 64, 2)) - 2)].decode("utf-16-le", "replace")
            self.paths[base + name] = i
            stack += [(le(e, 68, 4), base), (le(e, 72, 4), base)]
            if e[66] == 1:
                stack.append((le(e, 76, 4), f"{base}{name}/"))

    def read(self, path: str) -> bytes:
        i = self.paths.get(path)
        if i is None or self.entries[i][66] != 2:
            return b""
        start, size = le(self.entries[i], 116, 4), le(self.entries[i], 120, 4)
        if size >= self.least:
            return self.chain(start)[:size]
        out, seen = [], set()
        while start < END - 1 and start not in seen:
            seen.add(start)
            out.append(self.mini[start * self.mini_size : (start + 1) * self.mini_size])
            start = self.small[start] if start < len(self.small) else END
        return b"".join(out)[:size]


def filetime(n: int) -> str | None:
    try:
        return date_text(datetime(1601, 1, 1, tzinfo=UTC) + timedelta(microseconds=n // 10)) if n else None
    except OverflowError:
        return None


def properties(b: bytes, sets: int = 1) -> dict[int, object]:
    """Values of a property set stream's first section."""
    out: dict[int, object] = {}
    if len(b) < 48:
        return out
    base = le(b, 44, 4)
    page = 1252
    pairs = [(le(b, base + 8 + 8 * i, 4), base + le(b, base + 12 + 8 * i, 4)) for i in range(min(le(b, base + 4, 4), 1000))]
    for id, at in sorted(pairs, key=lambda p: p[0] != 1):
        kind = le(b, at, 4) & 0xFFF
        if kind == 2:
            v: object = le(b, at + 4, 2)
            page = v if id == 1 else page
        elif kind in (3, 0x13):
            v = le(b, at + 4, 4)
        elif kind == 0x0B:
            v = bool(le(b, at + 4, 2))
        elif kind == 0x1E:
            raw = b[at + 8 : at + 8 + le(b, at + 4, 4)].split(b"\0", 1)[0]
            v = text(raw) if page == 65001 else raw.decode(f"cp{page}", "replace") if page in (1250, 1251, 1252, 1253, 1254, 1255, 932, 936, 949, 950) else windows(raw)
        elif kind == 0x1F:
            v = b[at + 8 : at + 8 + 2 * le(b, at + 4, 4)].decode("utf-16-le", "replace").rstrip("\0")
        elif kind == 0x40:
            v = le(b, at + 4, 8)
        elif kind == 0x47:
            v = f"[{size_text(le(b, at + 4, 4))}]"
        else:
            continue
        out[id] = v
    return out


@parser("ole")
def compound(b: bytes, R: Report) -> None:
    try:
        c = Compound(b)
    except (ValueError, struct.error, IndexError):
        R.warn("Could not read the OLE structure")
        return
    names = list(c.paths)
    kinds = (("WordDocument", "DOC (Word 97-2003)"), ("Workbook", "XLS (Excel 97-2003)"), ("Book", "XLS (Excel 97-2003)"), ("PowerPoint Document", "PPT (PowerPoint 97-2003)"), ("VisioDocument", "VSD (Visio)"), ("__properties_version1.0", "MSG (Outlook email)"), ("EncryptedPackage", "Encrypted Office document"))
    R.info["type_label"] = next((label for n, label in kinds if n in c.paths), "OLE (CFB)")
    st = R.section("ole", "Document structure")
    st.add("Streams/storages", len(names))
    if "EncryptedPackage" in c.paths:
        v = c.read("EncryptionInfo")
        st.add("Encryption version", f"{le(v, 0, 2)}.{le(v, 2, 2)}")
        R.info["encrypted"] = True
        R.flag("encrypted", "warn", "Password-encrypted Office document — content and properties cannot be read")
    summary(c, R)
    if any(re.search("(^|/)(VBA|_VBA_PROJECT|Macros|_VBA_PROJECT_CUR)(/|$)", n) for n in names):
        R.flag("macro", "danger", "Contains macros (VBA)")
    if any(n.endswith("\1Ole10Native") for n in names):
        R.flag("ole10native", "danger", "Contains an embedded package (Ole10Native)")
    if any(re.search(r"(^|/)(ObjectPool|MBD[0-9A-F]+)/", n) for n in names):
        R.flag("embedded-ole", "warn", "Contains an embedded OLE object")
    if R.info["type_label"].startswith("MSG"):
        mail(c, R)
    st.add("Streams (first 40)", "\n".join(re.sub(r"[\0-\x1f]", "·", n) for n in names[:40]), False)


def summary(c: Compound, R: Report) -> None:
    s = R.section("doc-props", "Document properties")
    one = properties(c.read("\5SummaryInformation"))
    for id, label in SUMMARY.items():
        v = one.get(id)
        if id == 10 and isinstance(v, int):
            minutes = v // 600_000_000
            v = f"{minutes} min ({minutes // 60}:{minutes % 60:02d})" if v else None
        elif id in (11, 12, 13) and isinstance(v, int):
            v = filetime(v)
        elif id == 19 and isinstance(v, int):
            v = {1: "Password protected", 2: "Read-only recommended", 4: "Read-only enforced", 8: "Locked"}.get(v)
        s.add(label, v, id in (4, 8, 7) or None)
    for id, label in DOCUMENT.items():
        v = properties(c.read("\5DocumentSummaryInformation")).get(id)
        s.add(label, v if v else None, id in (14, 15) or None)
        if id == 15 and v:
            R.flag("company", "warn", "Contains company name")
    if one.get(4):
        R.highlight(f"👤 {one[4]}")
        R.flag("author", "warn", "Contains author name")
    if one.get(8):
        R.flag("last-editor", "warn", "Contains last-saved-by name")
    if one.get(2):
        R.info["title"] = one[2]
    if isinstance(one.get(14), int):
        R.info["pages"] = one[14]


def mail(c: Compound, R: Report) -> None:
    s = R.section("mail", "Email")

    def value(base: str, id: int) -> str | None:
        for kind, decode in (("001F", lambda x: x.decode("utf-16-le", "replace")), ("001E", windows)):
            if raw := c.read(f"{base}__substg1.0_{id:04X}{kind}"):
                return decode(raw).rstrip("\0")
        return None

    for id, label in MAIL.items():
        v = value("", id)
        s.add(label, v[:500] if v and id == 0x1000 else v, True)
    if heads := value("", 0x007D):
        R.flag("mail-headers", "warn", "Contains internet headers (server path/IP addresses)")
        s.add("IP addresses in headers", ", ".join(dict.fromkeys(re.findall(r"\b(?:\d{1,3}\.){3}\d{1,3}\b", heads))), True)
    folders = lambda kind: sorted({p.split("/")[0] for p in c.paths if p.startswith(f"__{kind}_version1.0_#")})
    s.add("Recipients", len(folders("recip")) or None)
    files = R.section("mail-files", "Attachments")
    for f in folders("attach"):
        name = value(f"{f}/", 0x3707) or value(f"{f}/", 0x3704) or latin(f.encode("latin-1", "replace"))
        files.add(name, " · ".join(x for x in (value(f"{f}/", 0x370E), size_text(len(c.read(f"{f}/__substg1.0_37010102")))) if x), True)
        if RISKY.search(name):
            R.flag("executable-attachment", "danger", "Contains an executable/macro attachment")
    if sender := value("", 0x0C1A):
        R.highlight(f"👤 {sender}")
    R.info["title"] = value("", 0x0037) or R.info.get("title")
