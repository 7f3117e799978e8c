"""ZIP archives: OOXML, OpenDocument, EPUB, JAR/APK and plain archives, by their public specifications."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from html import unescape

from . import parser
from .binary import size_text, text
from .pdf import EXECUTABLE
from .report import Report

RISKY = re.compile(r"\.(exe|dll|scr|com|js|jse|vbs|vbe|wsf|ps1|bat|cmd|hta|lnk|jar|msi|docm|xlsm|pptm|sh)$", re.I)
CORE = {"title": "Title", "subject": "Subject", "creator": "Author (creator)", "keywords": "Keywords", "description": "Description", "lastModifiedBy": "Last modified by", "revision": "Revision", "created": "Created", "modified": "Modified", "lastPrinted": "Last printed", "category": "Category", "contentStatus": "Status", "language": "Language", "identifier": "Identifier", "version": "Version"}
APP = {"Application": "Application", "AppVersion": "Application version", "Company": "Company", "Manager": "Manager", "TotalTime": "Total editing time", "Pages": "Pages", "Words": "Words", "Characters": "Characters", "CharactersWithSpaces": "Characters (with spaces)", "Lines": "Lines", "Paragraphs": "Paragraphs", "Slides": "Slides", "Notes": "Notes", "HiddenSlides": "Hidden slides", "MMClips": "Media clips", "Template": "Template", "DocSecurity": "Document security", "PresentationFormat": "Presentation format", "HyperlinkBase": "Hyperlink base"}
ODF = {"meta:generator": "Application", "dc:title": "Title", "dc:description": "Description", "dc:subject": "Subject", "meta:keyword": "Keyword", "meta:initial-creator": "Initial author", "dc:creator": "Last modified by", "meta:creation-date": "Created", "dc:date": "Modified", "meta:print-date": "Last printed", "meta:printed-by": "Printed by", "meta:editing-cycles": "Editing cycles", "meta:editing-duration": "Editing duration", "dc:language": "Language"}
PART = 32 << 20


class Archive:
    def __init__(self, b: bytes):
        self.z = zipfile.ZipFile(io.BytesIO(b))
        self.names = [i.filename for i in self.z.infolist()]
        self.have = set(self.names)

    def read(self, name: str) -> bytes | None:
        if name not in self.have:
            return None
        i = self.z.getinfo(name)
        if i.flag_bits & 1 or i.file_size > PART:
            return None
        try:
            return self.z.read(name)
        except (zipfile.BadZipFile, NotImplementedError, OSError, ValueError, struct.error):
            return None

    def text(self, name: str) -> str:
        return text(self.read(name) or b"")

    def matching(self, pattern: str) -> list[str]:
        return [n for n in self.names if re.search(pattern, n)]


def leaves(xml: str) -> list[tuple[str, str]]:
    """(tag, text) of elements without children."""
    return [(k, unescape(v).strip()) for k, v in re.findall(r"<([\w:.-]+)\b[^>]*?(?<!/)>([^<]*)</\1\s*>", xml)]


def attributes(xml: str, name: str) -> list[str]:
    return [unescape(a or b) for a, b in re.findall(rf"""\s{re.escape(name)}\s*=\s*(?:"([^"]*)"|'([^']*)')""", xml)]


def distinct(values) -> list[str]:
    return list(dict.fromkeys(v for v in values if v))


@parser("zip")
def archive(b: bytes, R: Report) -> None:
    try:
        a = Archive(b)
    except (zipfile.BadZipFile, ValueError, struct.error, OSError):
        R.warn("Could not read the ZIP directory (the file may be truncated)")
        return
    s, infos = R.section("zip", "Archive"), a.z.infolist()
    total, packed = sum(i.file_size for i in infos), sum(i.compress_size for i in infos)
    s.add("Entries", len(infos))
    s.add("Total uncompressed size", size_text(total))
    s.add("Archive comment", text(a.z.comment), True)
    if closed := sum(i.flag_bits & 1 for i in infos):
        s.add("Encrypted entries", closed)
        R.flag("zip-encrypted", "warn", f"{closed} encrypted entries")
    if dates := sorted(i.date_time for i in infos if i.date_time > (1980, 1, 1, 0, 0, 0)):
        said = ["{:04d}-{:02d}-{:02d} {:02d}:{:02d}:{:02d}".format(*d) for d in (dates[0], dates[-1])]
        s.add("Entry dates (local time)", said[0] if said[0] == said[1] else " – ".join(said))
    if any(n.startswith(("/", "\\")) or ".." in re.split(r"[\\/]", n) for n in a.names):
        R.flag("zip-slip", "danger", "Contains paths escaping the directory (zip slip)")
    if packed and total / packed > 200 and total > 10 << 20:
        R.flag("zip-bomb", "warn", f"Extreme compression ratio ({total // packed}×) — possible zip bomb")
    mime = a.text("mimetype").strip()
    if "[Content_Types].xml" in a.have:
        ooxml(a, R)
    elif "opendocument" in mime:
        odf(a, R, mime)
    elif mime == "application/epub+zip":
        epub(a, R)
    elif "META-INF/MANIFEST.MF" in a.have:
        java(a, R)
    else:
        R.info.setdefault("type_label", "ZIP")
        if risky := [n for n in a.names if RISKY.search(n)]:
            s.add("Executable/script files", ", ".join(risky[:20]), True)
            R.flag("zip-executable", "danger", f"Contains executable/script files ({len(risky)})")
        s.add("Contents (first 60)", "\n".join(a.names[:60]), False)
    pictures(a, R)


def pictures(a: Archive, R: Report) -> None:
    from . import load
    from .detect import TYPES, sniff

    if R.depth > 1:
        return
    named = a.matching(r"(?i)\.(jpe?g|png|webp|gif|tiff?|heic)$")
    told = 0
    for n in named[:200]:
        raw = a.read(n) or b""
        kind = sniff(raw)
        if not kind or TYPES[kind][1] != "image" or kind == "svg":
            continue
        sub = Report(R.depth + 1)
        try:
            load()[TYPES[kind][2]](raw, sub)
        except (ValueError, IndexError, struct.error):
            continue
        told += R.embed(sub, n)
        if re.search(r"(?i)thumbnail", n):
            R.thumb(raw)
    if named:
        R.section("zip", "Archive").add("Embedded images", f"{len(named)} ({told})")
    if told:
        R.flag("embedded-metadata", "info", "Embedded images contain metadata")


def ooxml(a: Archive, R: Report) -> None:
    kind = "DOCX" if a.matching("^word/") else "XLSX" if a.matching("^xl/") else "PPTX" if a.matching("^ppt/") else "VSDX" if a.matching("^visio/") else "OOXML"
    macros = bool(a.matching(r"(?i)vbaProject\.bin$"))
    R.info["type_label"] = f"{kind} (with macros)" if macros else kind
    props = R.section("doc-props", "Document properties")
    core = {k.rpartition(":")[2]: v for k, v in leaves(a.text("docProps/core.xml"))}
    for k, label in CORE.items():
        props.add(label, core.get(k), k in ("creator", "lastModifiedBy") or None)
    app, own = R.section("doc-app", "Application info"), dict(leaves(a.text("docProps/app.xml")))
    for k, label in APP.items():
        if own.get(k) and not (k == "DocSecurity" and own[k] == "0"):
            minutes = int(own[k]) if k == "TotalTime" and own[k].isdigit() else None
            app.add(label, f"{minutes} min ({minutes // 60}:{minutes % 60:02d})" if minutes is not None else own[k], k in ("Company", "Manager", "Template", "HyperlinkBase") or None)
    custom = R.section("doc-custom", "Custom properties")
    for name, body in re.findall(r"""<property\b[^>]*\sname="([^"]*)"[^>]*>(.*?)</property>""", a.text("docProps/custom.xml"), re.S):
        custom.add(unescape(name), unescape(re.sub("<[^>]+>", "", body)).strip(), True)
        if name.startswith("MSIP_Label_"):
            R.flag("purview", "warn", "Contains a Microsoft Purview sensitivity label (tenant ID)")
    for label in attributes(a.text("docMetadata/LabelInfo.xml"), "siteId"):
        R.section("doc-label", "Sensitivity label").add("siteId", label, True)
        R.flag("purview", "warn", "Contains a Microsoft Purview sensitivity label (tenant ID)")
    people = R.section("doc-people", "People and traces")
    for value, code, said in ((core.get("creator"), "author", "Contains author name"), (core.get("lastModifiedBy"), "last-editor", "Contains last-modified-by name"), (own.get("Company"), "company", "Contains company name")):
        if value:
            R.flag(code, "warn", said)
    if core.get("creator"):
        R.highlight(f"👤 {core['creator']}")
    if core.get("lastPrinted"):
        R.flag("printed", "info", "Document was printed (has last-printed date)")
    parts = {n: a.text(n) for n in a.matching(r"^(word|xl|ppt)/[^/]+\.xml$")}
    tracked = [(m, attributes(m, "w:author"), attributes(m, "w:date")) for n, x in parts.items() if n.startswith("word/") for m in re.findall(r"<w:(?:ins|del|moveFrom|moveTo|rPrChange|pPrChange)\b[^>]*>", x)]
    if tracked:
        people.add("Tracked-change authors", ", ".join(distinct(w for _, who, _ in tracked for w in who)), True)
        when = sorted(d for _, _, ds in tracked for d in ds)
        people.add("Tracked-change date range", f"{when[0]} – {when[-1]}" if when else None)
        R.flag("tracked", "warn", f"Contains unaccepted tracked changes ({len(tracked)})")
    comments = re.findall(r"<w:comment\b[^>]*>", parts.get("word/comments.xml", ""))
    writers = distinct(w for c in comments for w in attributes(c, "w:author"))
    for n in a.matching(r"^xl/(comments\d*|comments/comment\d*)\.xml$"):
        writers += [unescape(x) for x in re.findall(r"<author>([^<]*)</author>", a.text(n))]
    for n in ("ppt/commentAuthors.xml", "ppt/authors.xml"):
        writers += attributes(a.text(n), "name")
    if writers:
        people.add("Comment authors", ", ".join(distinct(writers)), True)
        R.flag("comments", "warn", f"Contains comments ({len(comments) or len(writers)})")
    for x in re.findall(r"<w15:person\b.*?(?:</w15:person>|/>)", parts.get("word/people.xml", ""), re.S):
        people.add(f"Person: {(attributes(x, 'w15:author') or ['?'])[0]}", ", ".join(attributes(x, "w15:userId")) or "—", True)
    for p in re.findall(r"<person\b[^>]*>", a.text("xl/persons/person.xml")):
        people.add(f"Person: {(attributes(p, 'displayName') or ['?'])[0]}", ", ".join(attributes(p, "userId")) or "—", True)
    st = R.section("doc-struct", "Document structure")
    settings = parts.get("word/settings.xml", "")
    sessions = set(re.findall(r'<w:rsid\s+w:val="([^"]+)"', settings))
    st.add("Editing session traces (rsid)", len(sessions) or None)
    st.add("Track changes", "Yes" if "<w:trackRevisions" in settings else None)
    st.add("Document protection", "Yes" if "<w:documentProtection" in settings else None)
    if hidden := sum(len(re.findall(r"<w:vanish\b(?![^>]*w:val=\"(?:0|false)\")", x)) for n, x in parts.items() if n == "word/document.xml"):
        st.add("Hidden text runs", hidden)
        R.flag("vanish", "warn", "Contains hidden (vanish) text")
    links(a, R)
    if kind == "XLSX":
        book = parts.get("xl/workbook.xml", "")
        sheets = []
        for x in re.findall(r"<sheet\b[^>]*>", book):
            state = (attributes(x, "state") or ["visible"])[0]
            sheets.append((attributes(x, "name") or ["?"])[0] + {"hidden": " [hidden]", "veryHidden": " [very hidden]"}.get(state, ""))
        st.add("Sheets", ", ".join(sheets))
        if n := sum(x.endswith("hidden]") for x in sheets):
            R.flag("hidden-sheets", "warn", f"Contains {n} hidden worksheet(s)")
        if where := re.search(r"<x15ac:absPath\b[^>]*\surl=\"([^\"]*)\"", book):
            st.add("Original save folder", unescape(where[1]), True)
            R.flag("abs-path", "warn", "Contains the local folder the file was saved in (may include a user name)")
        st.add("Defined names", ", ".join(attributes(" ".join(re.findall(r"<definedName\b[^>]*>", book)), "name")[:50]))
        for x in re.findall(r"<connection\b.*?(?:</connection>|/>)", a.text("xl/connections.xml"), re.S):
            st.add("Data connection", "; ".join(attributes(x, "connection") + attributes(x, "name")[:1]), True)
            R.flag("connection", "warn", "External data connection (may include server/user info)")
        st.add("External workbook links", len(a.matching(r"^xl/externalLinks/[^/]+\.xml$")) or None)
    if kind == "PPTX":
        slides, notes = len(a.matching(r"^ppt/slides/slide\d+\.xml$")), len(a.matching(r"^ppt/notesSlides/notesSlide\d+\.xml$"))
        st.add("Slides / speaker notes", f"{slides} / {notes}")
        R.info["pages"] = slides
        if notes:
            R.flag("notes", "info", "Contains speaker notes")
    elif (own.get("Pages") or "").isdigit():
        R.info["pages"] = int(own["Pages"])
    if core.get("title"):
        R.info["title"] = core["title"]
    if macros:
        R.flag("macro", "danger", "Contains macros (VBA)")
    if n := len(a.matching(r"(?i)/activeX/[^/]+\.xml$")):
        st.add("ActiveX controls", n)
        R.flag("activex", "danger", "Contains ActiveX controls")
    if objects := a.matching(r"(?i)/embeddings/"):
        st.add("Embedded objects", ", ".join(objects[:20]), True)
        R.flag("embedded-objects", "warn", f"Contains embedded objects/files ({len(objects)})")
    st.add("customXml parts", len(a.matching(r"^customXml/item\d+\.xml$")) or None)
    st.add("Preview thumbnail", "Present" if a.matching(r"(?i)^docProps/thumbnail\.") else None)


def links(a: Archive, R: Report) -> None:
    """External targets of relationships: remote templates, UNC and local paths."""
    s, shown = R.section("doc-links", "External links"), 0
    for n in a.matching(r"\.rels$"):
        for r in re.findall(r"<Relationship\b[^>]*>", a.text(n)):
            if "External" not in attributes(r, "TargetMode"):
                continue
            target, kind = (attributes(r, "Target") or [""])[0], (attributes(r, "Type") or [""])[0].rpartition("/")[2]
            shown += 1
            if shown <= 60:
                s.add(kind, target, True)
            if kind in ("attachedTemplate", "oleObject", "frame", "subDocument", "externalLinkPath") and re.match("https?:", target, re.I):
                R.flag(f"remote-{kind}", "danger", f"Remote {kind} is loaded (template injection risk): {target}")
            if re.match(r"(?i)(file:|\\\\|//|[a-z]:\\)", target):
                R.flag("unc", "danger", "External UNC/local file path (NTLM hash leak risk / user name)")
    if shown > 60:
        s.add("…", f"{shown - 60} more links")


def iso_duration(v: str) -> str:
    m = re.fullmatch(r"P(?:(\d+)D)?T?(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.\d+)?S)?", v)
    if not m:
        return v
    d, h, mi, s = (int(x or 0) for x in m.groups())
    return f"{24 * d + h}:{mi:02d}:{s:02d}"


def odf(a: Archive, R: Report, mime: str) -> None:
    R.info["type_label"] = {"text": "ODT", "spreadsheet": "ODS", "presentation": "ODP", "graphics": "ODG"}.get(mime.rpartition(".")[2].split("-")[0], "ODF")
    s, meta = R.section("doc-props", "Document properties"), a.text("meta.xml")
    s.add("MIME", mime, False)
    rows = leaves(meta)
    for k, v in rows:
        if k in ODF:
            s.add(ODF[k], iso_duration(v) if k == "meta:editing-duration" else v, k in ("meta:initial-creator", "dc:creator", "meta:printed-by") or None)
    for name, v in re.findall(r"""<meta:user-defined\b[^>]*meta:name="([^"]*)"[^>]*>([^<]*)<""", meta):
        s.add(unescape(name), unescape(v), True)
    if t := re.search(r"<meta:template\b[^>]*>", meta):
        s.add("Template", ", ".join(attributes(t[0], "xlink:href") + attributes(t[0], "xlink:title")), True)
    if t := re.search(r"<meta:document-statistic\b[^>]*>", meta):
        s.add("Statistics", ", ".join(f"{k}={v}" for k, v in re.findall(r'meta:([\w-]+)="([^"]*)"', t[0])))
    by = dict(rows)
    if by.get("meta:initial-creator") or by.get("dc:creator"):
        R.flag("author", "warn", "Contains author name")
        R.highlight(f"👤 {by.get('meta:initial-creator') or by['dc:creator']}")
    if by.get("meta:printed-by"):
        R.flag("printed", "info", "Document was printed (has printed-by info)")
    if a.matching(r"^(Basic|Scripts)/.+"):
        R.flag("macro", "danger", "Contains macros/scripts")
    if by.get("dc:title"):
        R.info["title"] = by["dc:title"]


def epub(a: Archive, R: Report) -> None:
    R.info["type_label"] = "EPUB"
    s = R.section("epub", "Book info")
    for n in a.matching(r"\.opf$")[:1]:
        x = a.text(n)
        for k, v in leaves(x):
            if k.startswith("dc:"):
                s.add(k, v)
        for m in re.findall(r"<meta\b[^>]*>", x):
            for k, v in zip(attributes(m, "name"), attributes(m, "content"), strict=False):
                s.add(k, v)
        by = dict(leaves(x))
        if by.get("dc:title"):
            R.info["title"] = by["dc:title"]
        if by.get("dc:creator"):
            R.highlight(f"👤 {by['dc:creator']}")


def java(a: Archive, R: Report) -> None:
    R.info["type_label"] = "APK (Android)" if "AndroidManifest.xml" in a.have else "JAR (Java)"
    s = R.section("jar", "Manifest")
    for k, v in re.findall(r"^([\w-]+): *(.*)$", a.text("META-INF/MANIFEST.MF").replace("\r", "").replace("\n ", ""), re.M)[:100]:
        s.add(k, v, k in ("Built-By", "Created-By", "Build-Host") or None)
        if k == "Built-By":
            R.flag("built-by", "warn", f"Build user name: {v}")
    signed = a.matching(r"^META-INF/[^/]+\.(RSA|DSA|EC|SF)$")
    s.add("Signature files", ", ".join(signed) or "None (unsigned)", False)


__all__ = ["EXECUTABLE", "Archive", "archive"]
