"""PDF: objects, revisions, encryption, document information, XMP, embedded files and security indicators."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

from . import parser
from .binary import half_up, inflated, latin, size_text, text
from .exif import emit_xmp, find_xmp
from .pdfcrypt import Crypt, open_empty
from .report import Report

SPACE = "[\0\t\n\f\r ]"
OBJECT = re.compile(rf"(?<![0-9])(\d+){SPACE}+(\d+){SPACE}+obj(?![A-Za-z0-9])")
#: Indicators counted among all names. Fixed values.
KEYS = "JavaScript JS OpenAction AA Launch EmbeddedFile EmbeddedFiles RichMedia XFA AcroForm SubmitForm ImportData GoToR GoToE URI ObjStm Encrypt JBIG2Decode Colors".split()
PAPER = (("A4", 595, 842), ("A3", 842, 1191), ("A5", 420, 595), ("Letter", 612, 792), ("Legal", 612, 1008))
LABELS = {"Title": "Title", "Author": "Author", "Subject": "Subject", "Keywords": "Keywords", "Creator": "Creator application", "Producer": "Producer", "CreationDate": "Creation date", "ModDate": "Modification date", "Trapped": "Trapped"}
PERMISSIONS = ((4, "Print"), (8, "Modify"), (16, "Copy"), (32, "Annotate"), (256, "Fill forms"), (1024, "Assemble"))
EXECUTABLE = re.compile(r"\.(exe|dll|scr|js|jse|vbs|vbe|ps1|bat|cmd|hta|lnk|jar|msi|iso|docm|xlsm|pptm)$", re.I)
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


class Name(str):
    pass


class Keyword(str):
    pass


@dataclass(frozen=True)
class Ref:
    number: int
    generation: int


class Dict(dict):
    """Values by key; spans: where each entry stands."""

    def __init__(self):
        super().__init__()
        self.spans: dict[str, tuple[int, int]] = {}


class Lexer:
    """Values of a PDF text (one character a byte): dict, list, bytes, Name, int, float, bool, None, Ref, Keyword."""

    BLANK = re.compile(rf"(?:{SPACE}|%[^\r\n]*)*")
    TOKEN = re.compile(r"[^\0\t\n\f\r ()<>\[\]{}/%]{0,256}")
    LATER = re.compile(rf"{SPACE}+(\d{{1,10}}){SPACE}+R(?![A-Za-z0-9])")
    NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)")

    def __init__(self, s: str, at: int = 0):
        self.s, self.at = s, at

    def skip(self) -> None:
        self.at = self.BLANK.match(self.s, self.at).end()

    def token(self) -> str:
        m = self.TOKEN.match(self.s, self.at)
        self.at = m.end()
        return m[0]

    def value(self, depth: int = 0):
        if depth > 64:
            raise ValueError("PDF object nested too deeply")
        self.skip()
        s, at = self.s, self.at
        two = s[at : at + 2]
        if not two:
            raise EOFError
        if two == "<<":
            return self.dictionary(depth)
        if two[0] == "[":
            return self.array(depth)
        if two[0] == "(":
            return self.literal()
        if two[0] == "<":
            end = s.find(">", at)
            end = len(s) if end < 0 else end
            digits = re.sub("[^0-9a-fA-F]", "", s[at + 1 : end])
            self.at = end + 1
            return bytes.fromhex(digits + "0" * (len(digits) % 2))
        if two[0] == "/":
            self.at += 1
            return Name(plain_name(self.token()))
        word = self.token()
        if not word:
            self.at += 1
            return Keyword(two[0])
        if self.NUMBER.fullmatch(word):
            if word.isdigit() and (m := self.LATER.match(s, self.at)):
                self.at = m.end()
                return Ref(int(word), int(m[1]))
            return int(word) if re.fullmatch(r"[+-]?\d+", word) else float(word)
        return {"true": True, "false": False, "null": None}.get(word, Keyword(word)) if word in ("true", "false", "null") else Keyword(word)

    def dictionary(self, depth: int) -> Dict:
        out = Dict()
        self.at += 2
        for _ in range(100_000):
            self.skip()
            if self.at >= len(self.s):
                break
            if self.s.startswith(">>", self.at):
                self.at += 2
                break
            start = self.at
            key = self.value(depth + 1)
            if isinstance(key, Name):
                out[str(key)] = self.value(depth + 1)
                out.spans[str(key)] = (start, self.at)
        return out

    def array(self, depth: int) -> list:
        out: list = []
        self.at += 1
        for _ in range(100_000):
            self.skip()
            if self.at >= len(self.s):
                break
            if self.s[self.at] == "]":
                self.at += 1
                break
            out.append(self.value(depth + 1))
        return out

    def literal(self) -> bytes:
        s, out, depth = self.s, [], 1
        self.at += 1
        while self.at < len(s):
            c = s[self.at]
            self.at += 1
            if c == "\\":
                m = re.compile(r"[0-7]{1,3}|\r\n|.", re.S).match(s, self.at)
                if not m:
                    break
                self.at = m.end()
                x = m[0]
                out.append(chr(int(x, 8) & 255) if x[0] in "01234567" else "" if x in ("\r\n", "\r", "\n") else ESCAPES.get(x, x))
                continue
            depth += (c == "(") - (c == ")")
            if not depth:
                break
            out.append(c)
        return "".join(out).encode("latin-1", "replace")


def plain_name(s: str) -> str:
    return re.sub("#([0-9a-fA-F]{2})", lambda m: chr(int(m[1], 16)), s)


@dataclass
class Definition:
    number: int
    generation: int
    start: int
    at: int


class Document:
    def __init__(self, b: bytes):
        self.b, self.s = b, latin(b)
        self.all = [Definition(int(m[1]), int(m[2]), m.start(), m.end()) for m in OBJECT.finditer(self.s)]
        self.last = {d.number: d for d in self.all}  # the last definition holds
        self.crypt: Crypt | None = None
        self.encrypt_number = -1
        self._packed: dict[int, tuple[str, int]] | None = None
        self.packed_texts: list[str] = []

    def parse(self, at: int):
        lexer = Lexer(self.s, at)
        try:
            return lexer.value(), lexer.at
        except (EOFError, ValueError, RecursionError):
            return None, lexer.at

    def head(self, at: int, n: int) -> str:
        return self.s[at : at + n]

    def named(self, pattern: str, n: int = 1024) -> list[Definition]:
        """Last definitions whose first characters match: a cheap test before they are parsed."""
        found = re.compile(pattern)
        return [d for d in self.last.values() if found.search(self.s, d.at, d.at + n)]

    def plain(self, v, number: int, generation: int, depth: int = 0):
        """A value with its strings decrypted."""
        if depth > 32:
            return v
        if isinstance(v, bytes):
            return self.crypt.read(self.crypt.strings, v, number, generation)
        if isinstance(v, list):
            return [self.plain(x, number, generation, depth + 1) for x in v]
        if isinstance(v, Dict):
            out = Dict()
            out.spans = v.spans
            for k, x in v.items():
                out[k] = self.plain(x, number, generation, depth + 1)
            return out
        return v

    def get(self, number: int):
        d = self.last.get(number)
        if d:
            v, _ = self.parse(d.at)
            return self.plain(v, number, d.generation) if self.crypt and self.crypt.ok and number != self.encrypt_number else v
        if number in self.packed:
            s, at = self.packed[number]
            try:
                return Lexer(s, at).value()
            except (EOFError, ValueError, RecursionError):
                return None
        return None

    def resolve(self, v):
        for _ in range(16):
            if not isinstance(v, Ref):
                break
            v = self.get(v.number)
        return v

    def range(self, at: int, length) -> tuple[int, int] | None:
        """Where a stream's bytes lie: by its length if that leads to its end, else up to the next end."""
        start = self.s.find("stream", at, at + 70)
        if start < 0:
            return None
        start += 6
        start += self.s.startswith("\r", start)
        start += self.s.startswith("\n", start)
        if isinstance(length, int) and "endstream" in self.s[start + length : start + length + 32]:
            return start, start + length
        end = self.s.find("endstream", start)
        if end < 0:
            return None
        end -= self.s[end - 1] == "\n"
        end -= self.s[end - 1] == "\r"
        return start, max(start, end)

    def stream(self, d: Definition) -> bytes | None:
        """Decoded bytes; None for other filters than Flate."""
        v, at = self.parse(d.at)
        place = self.range(at, self.resolve(v.get("Length"))) if isinstance(v, Dict) else None
        if not place:
            return None
        raw = self.b[place[0] : place[1]]
        filters = self.resolve(v.get("Filter"))
        filters = filters if isinstance(filters, list) else [] if filters is None else [filters]
        if self.crypt and self.crypt.ok and d.number != self.encrypt_number:
            kind = v.get("Type")
            if not (kind == "XRef" or "Crypt" in filters or kind == "Metadata" and not self.crypt.metadata):
                raw = self.crypt.read(self.crypt.streams, raw, d.number, d.generation)
        for f in filters:
            if f in ("FlateDecode", "Fl"):
                raw = inflated(raw)
            elif f != "Crypt":
                return raw if f in ("DCTDecode", "DCT") else None
        return raw

    @property
    def packed(self) -> dict[int, tuple[str, int]]:
        """Objects in object streams that have no definition of their own."""
        if self._packed is None:
            self._packed = {}
            for d in self.named(r"/Type\s*/ObjStm", 512)[:5000]:
                v, _ = self.parse(d.at)
                raw = self.stream(d)
                if raw is None or not isinstance(v, Dict):
                    continue
                s = latin(raw)
                self.packed_texts.append(s)
                n, first = (x if isinstance(x := self.resolve(v.get(k)), int) else 0 for k in ("N", "First"))
                numbers = [int(x) for x in s[:first].split()[: 2 * n] if x.isdigit()]
                for number, at in zip(numbers[::2], numbers[1::2], strict=False):
                    if number not in self.last:
                        self._packed[number] = (s, first + at)
        return self._packed

    def trailer(self) -> tuple[dict, set[int]]:
        """The last value of each entry over all trailers and cross-reference streams, and all numbers of info dictionaries."""
        places = [m.end() - 2 for m in re.finditer(rf"trailer{SPACE}*<<", self.s)]
        places += [d.at for d in self.all if re.search(r"/Type\s*/XRef", self.head(d.at, 1024))]
        out, infos = {}, set()
        for at in sorted(places):
            v, _ = self.parse(at)
            if isinstance(v, Dict):
                out |= {k: v[k] for k in ("Info", "Root", "Encrypt", "ID") if v.get(k) is not None}
                if isinstance(v.get("Info"), Ref):
                    infos.add(v["Info"].number)
        return out, infos


def shown(v) -> str | None:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, bytes):
        for mark, encoding in ((b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"), (b"\xef\xbb\xbf", "utf-8")):
            if v.startswith(mark):
                return v[len(mark) :].decode(encoding, "replace").rstrip("\0")
        return latin(v).rstrip("\0")
    if isinstance(v, Name):
        return f"/{v}"
    if isinstance(v, int | float):
        return f"{v:g}" if isinstance(v, float) else str(v)
    if isinstance(v, list):
        return ", ".join(shown(x) or "" for x in v)
    if isinstance(v, Ref):
        return f"{v.number} {v.generation} R"
    return f"<< {' '.join('/' + k for k in v)} >>" if isinstance(v, dict) else None


DATE = re.compile(r"(?:D:)?(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?([Zz+-])?(\d\d)?'?(\d\d)?")


def date(s: str | None) -> str | None:
    m = DATE.match(s or "")
    if not m:
        return s
    y, *parts = m.groups()
    mo, d, h, mi, se = (x or fallback for x, fallback in zip(parts[:5], ("01", "01", "00", "00", "00"), strict=True))
    zone = "" if not m[7] else " UTC" if m[7] in "Zz" else f" {m[7]}{m[8] or '00'}:{m[9] or '00'}"
    return f"{y}-{mo}-{d} {h}:{mi}:{se}{zone}"


def with_files(v, depth: int = 0):
    """Dictionaries that name an embedded file."""
    if depth > 6:
        return
    if isinstance(v, dict):
        if v.get("EF") is not None:
            yield v
        for k, x in v.items():
            if k not in ("Parent", "P"):
                yield from with_files(x, depth + 1)
    elif isinstance(v, list):
        for x in v:
            yield from with_files(x, depth + 1)


@parser("pdf")
def pdf(b: bytes, R: Report) -> None:
    from . import load
    from .detect import TYPES, sniff

    doc = Document(b)
    s = doc.s
    info, struct_, security = (R.section(id, title) for id, title in (("pdf-info", "PDF document info"), ("pdf-struct", "PDF structure"), ("pdf-sec", "PDF security indicators")))
    trailer, _ = doc.trailer()
    encrypt = None
    if trailer.get("Encrypt") is not None:
        if isinstance(trailer["Encrypt"], Ref):
            doc.encrypt_number = trailer["Encrypt"].number
        encrypt = doc.resolve(trailer["Encrypt"])
        first = trailer["ID"][0] if isinstance(trailer.get("ID"), list) and trailer["ID"] else b""
        try:
            doc.crypt = open_empty(encrypt, first if isinstance(first, bytes) else b"") if isinstance(encrypt, dict) else Crypt(False, reason="Could not read the Encrypt dictionary")
        except (ValueError, TypeError, IndexError) as e:
            doc.crypt = Crypt(False, reason=f"Decryption failed: {e}")
    readable = doc.crypt is None or doc.crypt.ok
    catalog = doc.resolve(trailer.get("Root"))
    catalog = catalog if isinstance(catalog, dict) else {}

    version, own = re.search(r"%PDF-(\d\.\d)", s[:1024]), catalog.get("Version")
    struct_.add("PDF version", (version[1] + (f" (catalog: {own})" if own and own != version[1] else "")) if version else "?")
    if (offset := s.find("%PDF-")) > 0:
        struct_.add("Data before header", size_text(offset), True)
        R.flag("polyglot", "warn", f"{offset} bytes before the %PDF header (possible polyglot)")
    if isinstance(encrypt, dict):
        struct_.add("Encryption", f"{encrypt.get('Filter', '?')} · {doc.crypt.about or f'V{encrypt.get(chr(86))} R{encrypt.get(chr(82))}'}")
        if isinstance(encrypt.get("P"), int):
            struct_.add("Permissions", "  ".join(f"{'✓' if encrypt['P'] & bit else '✗'} {name}" for bit, name in PERMISSIONS))
        R.info["encrypted"] = True
        struct_.add("Decryption", "User password is empty — fields decrypted" if doc.crypt.ok else doc.crypt.reason)
        if doc.crypt.ok:
            R.flag("encrypted-open", "info", "PDF is encrypted (opens without a password) — fields decrypted")
        else:
            R.flag("encrypted", "warn", f"PDF is password protected — {doc.crypt.reason}")

    I = doc.resolve(trailer.get("Info")) if readable else None  # noqa: E741
    if isinstance(I, dict):
        one = {k: shown(doc.resolve(v)) for k, v in I.items()}
        for k in sorted(one, key=lambda k: k not in LABELS):
            v = date(one[k]) if k.endswith("Date") else one[k]
            info.add(LABELS.get(k, k), v, True if k not in LABELS or re.search("Author|Creator|Producer", k) else None)
        if one.get("Title"):
            R.info["title"] = one["Title"]
        if one.get("Author"):
            R.highlight(f"👤 {one['Author']}")
            R.flag("author", "warn", "Contains author name")
        if one.get("Creator") or one.get("Producer"):
            R.highlight(f"🛠 {one.get('Creator') or one['Producer']}")
        made, changed = one.get("CreationDate"), one.get("ModDate")
        if made:
            R.highlight(f"🕒 {date(made)}")
        if made and changed and made[:16] != changed[:16]:
            R.flag("dates-differ", "info", "Creation and modification dates differ")
    if isinstance(trailer.get("ID"), list):
        ids = [x.hex()[:64] for x in trailer["ID"] if isinstance(x, bytes) and x]
        struct_.add("Document ID", ids[0] if len(set(ids)) == 1 else " / ".join(ids), True)
        if len(ids) == 2 and ids[0] != ids[1]:
            R.flag("id-differs", "info", "Document ID pair differs — modified after being saved")

    main = -1
    if catalog:
        pages = doc.resolve(catalog.get("Pages"))
        if isinstance(pages, dict) and isinstance(pages.get("Count"), int):
            R.info["pages"] = pages["Count"]
        struct_.add("Language", shown(doc.resolve(catalog.get("Lang"))))
        struct_.add("Page mode", shown(catalog.get("PageMode")))
        struct_.add("Tagged (accessible) PDF", "Yes" if catalog.get("MarkInfo") or catalog.get("StructTreeRoot") else None)
        struct_.add("Bookmarks", "Present" if catalog.get("Outlines") else None)
        if catalog.get("PieceInfo") is not None:
            struct_.add("PieceInfo (private application data)", "Present", True)
            R.flag("pieceinfo", "info", "Contains hidden application data (PieceInfo, e.g. Illustrator)")
        form = doc.resolve(catalog.get("AcroForm"))
        if isinstance(form, dict):
            fields = doc.resolve(form.get("Fields"))
            struct_.add("Form (AcroForm)", (f"{len(fields)} fields" if isinstance(fields, list) else "Present") + (" + XFA" if form.get("XFA") else ""))
            if form.get("SigFlags"):
                R.flag("signature", "info", "Contains a digital signature field")
        if isinstance(catalog.get("Metadata"), Ref):
            main = catalog["Metadata"].number
            raw = doc.stream(doc.last[main]) if main in doc.last else None
            if raw is not None and not emit_xmp(R, text(raw)):
                R.warn("Could not parse the XMP stream")
    if readable and not R.has("xmp") and (x := find_xmp(b)):
        emit_xmp(R, x)

    shown_xmp = rest = 0
    for d in doc.named(r"/Type\s*/Metadata", 512):
        if d.number != main:
            if shown_xmp >= 15:
                rest += 1
            elif (raw := doc.stream(d)) is not None and emit_xmp(R, text(raw), f"Object XMP · obj {d.number}", f"oxmp-{d.number}"):
                shown_xmp += 1
    if shown_xmp:
        struct_.add("Object-level XMP", shown_xmp + rest)
        R.flag("object-xmp", "info", "Placed objects carry their own XMP (original file info)")

    jpegs = [d for d in doc.named(r"/Subtype\s*/Image") if re.search(r"/DCTDecode|/DCT\b", doc.head(d.at, 1024))]
    told = 0
    for d in jpegs[:400]:
        raw = doc.stream(d)
        if raw and raw[:2] == b"\xff\xd8":
            v, sub = doc.parse(d.at)[0], Report(R.depth + 1)
            load()["jpeg"](raw, sub)
            told += R.embed(sub, f"PDF image obj {d.number}" + (f" ({v['Width']}×{v.get('Height')})" if v.get("Width") else ""))
    struct_.add("JPEG images (with metadata)", f"{len(jpegs)} ({told})" if jpegs else None)

    if readable:
        holders = [doc.get(d.number) for d in doc.named(r"/EF\b", 4096)] + [doc.get(n) for n, (t, at) in doc.packed.items() if re.search(r"/EF\b", t[at : at + 4096])]
        attachments(doc, R, holders, load(), TYPES, sniff)

    indicators(doc, R, struct_, security)


def attachments(doc: Document, R: Report, holders: list, parsers: dict, types: dict, sniff) -> None:
    seen: set[int] = set()
    for d in [d for v in holders for d in with_files(v)]:
        files = doc.resolve(d["EF"])
        ref = (files.get("UF") or files.get("F")) if isinstance(files, dict) else None
        if not isinstance(ref, Ref) or ref.number in seen or len(seen) > 100:
            continue
        seen.add(ref.number)
        place = doc.last.get(ref.number)
        about = doc.parse(place.at)[0] if place else None
        about = about if isinstance(about, dict) else {}
        params = doc.resolve(about.get("Params"))
        params = params if isinstance(params, dict) else {}
        name = shown(doc.resolve(d.get("UF") or d.get("F"))) or f"attachment-{ref.number}"
        dates = [f"{label} {date(shown(doc.resolve(params[k])))}" for k, label in (("CreationDate", "created"), ("ModDate", "modified")) if params.get(k)]
        parts = [size_text(params["Size"]) if isinstance(params.get("Size"), int) else None, about.get("Subtype"), shown(doc.resolve(d.get("Desc"))), *dates]
        R.section("pdf-files", "PDF attachments").add(name, " · ".join(p for p in parts if p) or "—", True)
        if EXECUTABLE.search(name):
            R.flag("executable-attachment", "danger", f"Executable/macro attachment: {name}")
        raw = doc.stream(place) if place and R.depth < 1 else None
        kind = sniff(raw) if raw and len(raw) < 32 << 20 else None
        if kind:
            sub = Report(R.depth + 1)
            try:
                parsers[types[kind][2]](raw, sub)
            except (ValueError, IndexError, KeyError, struct.error):
                continue
            R.embed(sub, f"attachment: {name}")


def indicators(doc: Document, R: Report, struct_, security) -> None:
    counts = dict.fromkeys(KEYS, 0)
    hidden = images = pages = 0
    fonts: dict[str, None] = {}
    media = None
    doc.packed  # noqa: B018  their texts are searched as well
    for s in [doc.s, *doc.packed_texts]:
        for raw in re.findall(rf"/([A-Za-z0-9#]{{2,20}})(?=[\0\t\n\f\r /\[\]<>()%])", s):
            name = plain_name(raw) if "#" in raw else raw
            if name in counts:
                counts[name] += 1
                hidden += name != raw
        for f in re.findall(r"/BaseFont\s*/([^\0\t\n\f\r /\[\]<>()%]+)", s):
            if len(fonts) < 60:
                fonts[re.sub(r"^[A-Z]{6}\+", "", f).replace("#20", " ")] = None
        images += len(re.findall(r"/Subtype\s*/Image\b", s))
        pages += len(re.findall(r"/Type\s*/Page(?![A-Za-z])", s))
        if not media and (m := re.search(r"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s*\]", s)):
            try:
                x0, y0, x1, y1 = map(float, m.groups())
                media = half_up(x1 - x0), half_up(y1 - y0)
            except ValueError:
                pass
    if not R.info.get("pages") and pages and not R.partial:
        R.info["pages"] = pages
    struct_.add("Page count", R.info.get("pages"))
    if media:
        w, h = media
        near = lambda a, b: abs(a - w) < 4 and abs(b - h) < 4
        paper = next((f" — {n}" for n, a, b in PAPER if near(a, b) or near(b, a)), "")
        struct_.add("Page size", f"{w} × {h} pt ({half_up(w * 0.3528)} × {half_up(h * 0.3528)} mm){paper}")
    fast = bool(re.search(r"/Linearized\b", doc.s[:2048]))
    struct_.add("Linearized (fast web view)", "Yes" if fast else "No")
    if not R.partial:
        revisions = max(1, doc.s.count("%%EOF") - fast)
        struct_.add("Revisions (incremental updates)", revisions)
        if revisions > 1:
            R.flag("revisions", "warn", f"Incrementally updated {revisions - 1} time(s) after creation")
        struct_.add("Object count", len(doc.last) + len(doc.packed))
    struct_.add("Image objects", images or None)
    struct_.add("Fonts", ", ".join(fonts), False)
    for k in KEYS:
        security.add(f"/{k}", counts[k] or None, False)
    security.add("Hex-obfuscated names", hidden or None, True)
    has = lambda *names: any(counts[n] for n in names)
    for yes, code, level, said in (
        (has("JavaScript", "JS"), "pdf-js", "danger", "PDF contains JavaScript"),
        (has("Launch"), "pdf-launch", "danger", "PDF contains a /Launch action (runs external programs)"),
        (has("EmbeddedFile", "EmbeddedFiles"), "pdf-embedded", "danger", "PDF contains embedded files"),
        (has("RichMedia"), "pdf-richmedia", "warn", "PDF contains RichMedia (Flash/media)"),
        (has("XFA"), "pdf-xfa", "warn", "PDF contains an XFA form"),
        (has("OpenAction", "AA"), "pdf-auto", "warn", "Contains an action that runs on open/automatically (/OpenAction, /AA)"),
        (has("SubmitForm", "ImportData", "GoToR", "GoToE"), "pdf-external", "warn", "Contains an action that sends/fetches external data"),
        (has("JBIG2Decode"), "pdf-jbig2", "info", "Uses JBIG2 compression"),
        (hidden, "pdf-hex", "danger", "PDF names obfuscated with hex encoding (suspicious)"),
        (has("URI"), "pdf-uri", "info", f"Contains {counts['URI']} links (URI)"),
    ):
        if yes:
            R.flag(code, level, said)
    if n := R.info.get("pages"):
        R.highlight(f"📄 {n} {'page' if n == 1 else 'pages'}")
