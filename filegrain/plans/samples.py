"""Small sample files of each format, assembled from their specifications, for queries and tests."""

from __future__ import annotations


import hashlib
import io
import struct
import wave
import zipfile
import zlib
from functools import cache, partial

from ..operators.extract import pdfcrypt


def tiff(order="<", make="Optika", model="Model M5", lat=(60, 23, 34.8), lon=(5, 19, 27.12), refs=("N", "E"), orientation=6, serial="987654"):
    """A TIFF block with an image, a capture and a GPS directory."""
    p = lambda f, *v: struct.pack(order + f, *v)
    data, entries = bytearray(), {"image": [], "capture": [], "gps": []}

    def put(directory, tag, kind, n, raw):
        entries[directory].append((tag, kind, n, raw))

    text = lambda s: s.encode() + b"\0"
    ratio = lambda xs: b"".join(p("II", round(x * 100), 100) for x in xs)
    put("image", 0x10F, 2, len(make) + 1, text(make))
    put("image", 0x110, 2, len(model) + 1, text(model))
    put("image", 0x112, 3, 1, p("H", orientation))
    put("image", 0x131, 2, 8, text("Editor1"))
    put("capture", 0x9003, 2, 20, text("2024:01:02 03:04:05"))
    put("capture", 0x829A, 5, 1, p("II", 1, 250))
    put("capture", 0xA431, 2, len(serial) + 1, text(serial))
    put("capture", 0xA434, 2, 11, text("ZM24-105mm"))
    put("gps", 1, 2, 2, text(refs[0]))
    put("gps", 2, 5, 3, ratio(lat))
    put("gps", 3, 2, 2, text(refs[1]))
    put("gps", 4, 5, 3, ratio(lon))
    put("gps", 6, 5, 1, p("II", 350, 10))
    size = lambda d: 2 + 12 * (len(entries[d]) + 2 * (d == "image")) + 4
    at = {"image": 8}
    at["capture"] = 8 + size("image")
    at["gps"] = at["capture"] + size("capture")
    free = at["gps"] + size("gps")
    entries["image"] += [(0x8769, 4, 1, p("I", at["capture"])), (0x8825, 4, 1, p("I", at["gps"]))]
    head = (b"II*\0" if order == "<" else b"MM\0*") + p("I", 8)
    out = bytearray(head)
    for d in ("image", "capture", "gps"):
        out += p("H", len(entries[d]))
        for tag, kind, n, raw in entries[d]:
            if len(raw) <= 4:
                out += p("HHI", tag, kind, n) + raw.ljust(4, b"\0")
            else:
                out += p("HHII", tag, kind, n, free + len(data))
                data += raw + b"\0" * (len(raw) % 2)
        out += p("I", 0)
    return bytes(out + data)


XMP = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmp:CreatorTool="Painter 9"><dc:creator><rdf:Seq><rdf:li>Nils Berg</rdf:li></rdf:Seq></dc:creator><dc:title><rdf:Alt><rdf:li xml:lang="x-default">A title</rdf:li></rdf:Alt></dc:title></rdf:Description></rdf:RDF></x:xmpmeta>'


def iptc():
    record = lambda n, v: b"\x1c\x02" + bytes([n]) + struct.pack(">H", len(v)) + v
    body = record(90, b"Bergen") + record(80, b"Someone")
    return b"Photoshop 3.0\0" + b"8BIM\x04\x04\0\0" + struct.pack(">I", len(body)) + body


def jpeg(exif=True, trailing=130, width=640, height=480):
    seg = lambda m, d: b"\xff" + bytes([m]) + struct.pack(">H", len(d) + 2) + d
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\2\1\0\x48\0\x48\0\0")
    if exif:
        out += seg(0xE1, b"Exif\0\0" + tiff()) + seg(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + XMP.encode()) + seg(0xED, iptc()) + seg(0xFE, b"a hidden comment")
    out += seg(0xDB, bytes(65)) + seg(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])) + seg(0xC4, bytes(20))
    out += seg(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0])) + b"\x12\x34\xff\x00\x56" * 20 + b"\xff\xd9"
    return out + b"x" * trailing


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0))
    out += chunk(b"pHYs", struct.pack(">IIB", 2835, 2835, 1)) + chunk(b"tIME", struct.pack(">HBBBBB", 2024, 1, 2, 3, 4, 5))
    out += chunk(b"tEXt", b"comment\0hello") + chunk(b"zTXt", b"Author\0\0" + zlib.compress(b"Lena")) + chunk(b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0" + XMP.encode()) + chunk(b"tEXt", b"parameters\0steps 20")
    out += chunk(b"eXIf", tiff(">", refs=("S", "W"), lat=(40, 0, 0), lon=(10, 0, 0)))
    return out + chunk(b"IDAT", zlib.compress(bytes(20))) + chunk(b"IEND", b"") + b"trailing data"


def gif():
    out = b"GIF89a" + struct.pack("<HHBBB", 4, 5, 0x80, 0, 0) + bytes(6)
    out += b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00" + b"\x21\xfe\x0agif remark\0" + b"\x21\xff\x0bXMP DataXMP\x01a\x00"
    return out + b"\x2c" + struct.pack("<HHHHB", 0, 0, 4, 5, 0) + b"\x02\x02\x4c\x01\0" + b"\x3b"


def riff(form, *chunks):
    body = b"".join(k + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2) for k, d in chunks)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + form + body


def webp():
    return riff(b"WEBP", (b"VP8X", bytes([0x0C, 0, 0, 0]) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")), (b"VP8L", b"\x2f" + bytes(8)), (b"EXIF", tiff()), (b"XMP ", XMP.encode()))


SVG = """<?xml version="1.0"?><!-- Generator: Illustrator 27 --><svg xmlns="http://www.w3.org/2000/svg" xmlns:inkscape="http://i" width="10" height="20" sodipodi:docname="secret.svg" inkscape:export-filename="/Users/nils/x.png"><title>T &amp; t</title><metadata>%s</metadata><script>1</script><a onclick="x()" href="javascript:y"/></svg>""" % XMP


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def mov():
    mac = 2082844800 + 1704067200  # 2024-01-01
    mvhd = box(b"mvhd", struct.pack(">IIIII", 0, mac, mac + 60, 600, 25200), bytes(80))
    tkhd = box(b"tkhd", struct.pack(">IIIIII", 7, mac, mac, 1, 0, 25200), bytes(52), struct.pack(">II", 1920 << 16, 1080 << 16))
    mdhd = box(b"mdhd", struct.pack(">IIIIIHH", 0, mac, mac, 600, 25200, (5 << 10) | (14 << 5) | 7, 0))
    hdlr = box(b"hdlr", bytes(8), b"vide", bytes(12), b"\0")
    stsd = box(b"stsd", struct.pack(">II", 0, 1), struct.pack(">I", 86) + b"avc1" + bytes(42) + b"\x05H.264".ljust(32, b"\0") + bytes(4))
    trak = box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, box(b"minf", box(b"stbl", stsd))))
    text = b"+60.3913+005.3221+010/"
    udta = box(b"udta", box(b"\xa9xyz", struct.pack(">HH", len(text), 0), text), box(b"\xa9swr", struct.pack(">HH", 9, 0), b"Soft 1.41"))
    key = b"com.apple.quicktime.model"
    keys = box(b"keys", struct.pack(">II", 0, 1), struct.pack(">I", 8 + len(key)) + b"mdta" + key)
    ilst = box(b"ilst", box(struct.pack(">I", 1), box(b"data", struct.pack(">II", 1, 0), b"Phone 15")))
    meta = box(b"meta", box(b"hdlr", bytes(8), b"mdta", bytes(12)), keys, ilst)
    return box(b"ftyp", b"qt  ", bytes(4), b"qt  ") + box(b"moov", mvhd, trak, udta, meta) + box(b"mdat", bytes(32))


def heic():
    exif = struct.pack(">I", 6) + b"Exif\0\0" + tiff()
    infe = box(b"infe", b"\2\0\0\0", struct.pack(">HH", 1, 0), b"Exif", b"\0")
    iinf = box(b"iinf", bytes(4), struct.pack(">H", 1), infe)
    ispe = box(b"iprp", box(b"ipco", box(b"ispe", struct.pack(">III", 0, 64, 64)), box(b"ispe", struct.pack(">III", 0, 4000, 3000))))

    def meta(offset):
        iloc = box(b"iloc", bytes(4), b"\x44\x00", struct.pack(">HHHHII", 1, 1, 0, 1, offset, len(exif)))
        return box(b"meta", bytes(4), box(b"hdlr", bytes(8), b"pict", bytes(12)), iinf, iloc, ispe)

    head = box(b"ftyp", b"heic", bytes(4), b"mif1heic")
    return head + meta(len(head) + len(meta(0)) + 8) + box(b"mdat", exif)


def m4a():
    data = lambda v, kind=1: box(b"data", struct.pack(">II", kind, 0), v)
    ilst = box(b"ilst", box(b"\xa9nam", data(b"Episode 1")), box(b"----", box(b"mean", bytes(4), b"com.apple.iTunes"), box(b"name", bytes(4), b"NOTE"), data(b"x")), box(b"covr", data(jpeg(trailing=0), 13)))
    meta = box(b"meta", bytes(4), box(b"hdlr", bytes(8), b"mdir", bytes(12)), ilst)
    return box(b"ftyp", b"M4A ", bytes(4), b"M4A ") + box(b"moov", box(b"udta", meta))


def id3():
    frame = lambda k, d: k + struct.pack(">IH", len(d), 0) + d
    body = frame(b"TIT2", b"\1\xff\xfe" + "Şarkı".encode("utf-16-le")) + frame(b"TPE1", b"\3Artist") + frame(b"TXXX", b"\0Recorder\0Room 5") + frame(b"COMM", b"\0engabout\0hidden remark") + frame(b"PRIV", b"www.shop.test\0" + bytes(9)) + frame(b"APIC", b"\0image/jpeg\0\3\0" + jpeg(trailing=0)) + frame(b"GEOB", b"\0a/b\0f.exe\0d\0data")
    n = len(body)
    return b"ID3\3\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body


def mp3():
    frame = b"\xff\xfb\x90\x64" + bytes(413)
    v1 = b"TAG" + b"V1 title".ljust(30, b"\0") + b"a".ljust(30, b"\0") + b"b".ljust(30, b"\0") + b"1999" + b"c".ljust(28, b"\0") + b"\0\5\0"
    ape = b"APETAGEX" + struct.pack("<IIII", 2000, 32, 0, 0) + bytes(8)
    return id3() + frame * 20 + ape + v1


def vorbis(*pairs):
    return struct.pack("<I", 5) + b"enc 1" + struct.pack("<I", len(pairs)) + b"".join(struct.pack("<I", len(p)) + p for p in pairs)


def flac():
    info = struct.pack(">HH", 4096, 4096) + bytes(6) + struct.pack(">Q", 44100 << 44 | 1 << 41 | 15 << 36 | 88200) + bytes(16)
    block = lambda kind, d, last=0: bytes([kind | last]) + len(d).to_bytes(3, "big") + d
    picture = struct.pack(">II", 3, 10) + b"image/jpeg" + struct.pack(">I", 0) + struct.pack(">IIII", 1, 1, 24, 0)
    cover = jpeg(trailing=0)
    return b"fLaC" + block(0, info) + block(4, vorbis(b"TITLE=A track", b"ENCODED_BY=Some PC")) + block(6, picture + struct.pack(">I", len(cover)) + cover) + block(1, bytes(8), 128) + b"\xff\xf8frames"


def opus():
    page = lambda granule, d: b"OggS\0\0" + struct.pack("<QIII", granule, 1, 0, 0) + bytes([1, min(255, len(d))]) + d
    return page(0, b"OpusHead\1\2" + struct.pack("<HIhB", 312, 48000, 0, 0)) + page(0, b"OpusTags" + vorbis(b"TITLE=A recording")) + page(125 * 48000 + 312, bytes(20))


def wav():
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((2, 2, 44100, 0, "NONE", ""))
        w.writeframes(bytes(88200 * 4))
    b = out.getvalue()[12:]
    bext = b"about".ljust(256, b"\0") + b"Recorder 9".ljust(32, b"\0") + b"ref".ljust(32, b"\0") + b"2024-01-0203:04:05" + bytes(264) + b"A=PCM"
    chunks = b + b"LIST" + struct.pack("<I", 4 + 8 + 10 + 8 + 8) + b"INFO" + b"INAM" + struct.pack("<I", 9) + b"A title\0\0\0" + b"ISFT" + struct.pack("<I", 8) + b"Editor1\0" + b"bext" + struct.pack("<I", len(bext)) + bext + b"\0" * (len(bext) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def avi():
    avih = struct.pack("<IIIIIIIIIIIIII", 40000, 0, 0, 0, 250, 0, 1, 0, 640, 480, 0, 0, 0, 0)
    lst = lambda kind, *cs: (b"LIST", kind + b"".join(k + struct.pack("<I", len(d)) + d for k, d in cs))
    return riff(b"AVI ", lst(b"hdrl", (b"avih", avih), (b"strh", b"vidsMJPG" + bytes(48))), lst(b"INFO", (b"ISFT", b"CamMVI_007\0\0"), (b"IDIT", b"2024-01-02\0\0")), lst(b"movi", (b"00dc", bytes(16))))


def mkv():
    def size(n):
        return (1 << 56 | n).to_bytes(8, "big")

    el = lambda id, d: bytes.fromhex(id) + size(len(d)) + d
    ns = (1704067200 - 978307200) * 10**9
    info = el("2ad7b1", (1000000).to_bytes(3, "big")) + el("4489", struct.pack(">d", 93500)) + el("4461", ns.to_bytes(8, "big")) + el("5741", b"Muxer 3.1") + el("7ba9", b"A film")
    track = el("ae", el("83", b"\1") + el("86", b"V_MPEG4/ISO/AVC") + el("e0", el("b0", b"\7\x80") + el("ba", b"\4\x38")))
    tags = el("7373", el("67c8", el("45a3", b"ENCODER") + el("4487", b"Coder 60")))
    files = el("61a7", el("466e", b"font.ttf") + el("4660", b"font/ttf"))
    return el("1a45dfa3", el("4282", b"matroska")) + el("18538067", el("1549a966", info) + el("1654ae6b", track) + el("1f43b675", bytes(64)) + el("1254c367", tags) + el("1941a469", files))


def pdf(objects, info=3, root=1, extra=b"", ids=(b"\1" * 16, b"\2" * 16)):
    out = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, d) for n, d in objects.items())
    trailer = b"trailer\n<< /Root %d 0 R /Info %d 0 R /ID [<%s> <%s>] %s>>\nstartxref\n0\n%%%%EOF\n" % (root, info, ids[0].hex().encode(), ids[1].hex().encode(), extra)
    return out + trailer


def stream(entries, data):
    return b"<< %s /Length %d >>\nstream\n%s\nendstream" % (entries, len(data), data)


PDF_INFO = b"<< /Title <feff%s> /Author (Can \\(test\\) \\351) /Producer (Maker) /CreationDate (D:20240102030405+03'00') /ModDate (D:20240203030405Z) >>" % "Übersicht".encode("utf-16-be").hex().encode()


def pdf_plain():
    packed = b"7 0 8 30 " + b"<< /Type /Font /BaseFont /AB >>".ljust(30) + b"<< /S /#4aavaScript /#4a#53 (x) >>"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R /Metadata 4 0 R /OpenAction 8 0 R /Lang (en) >>",
        2: b"<< /Type /Pages /Count 2 /Kids [] /MediaBox [0 0 595 842] >>",
        3: PDF_INFO,
        4: stream(b"/Type /Metadata /Subtype /XML /Filter /FlateDecode", zlib.compress(XMP.encode())),
        5: stream(b"/Type /ObjStm /N 2 /First 9 /Filter /FlateDecode", zlib.compress(packed)),
    }
    return pdf(objects) + b"6 0 obj\n<< /Type /Page /Note 1 >>\nendobj\ntrailer\n<< /Root 1 0 R /Info 3 0 R >>\n%%EOF\n"


def pdf_rich():
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R /Names 7 0 R /PieceInfo << >> >>",
        2: b"<< /Type /Pages /Count 1 /Kids [] >>",
        3: b"<< /Author (Info author) >>",
        4: stream(b"/Type /XObject /Subtype /Image /Width 640 /Height 480 /Filter /DCTDecode", jpeg(trailing=0)),
        5: stream(b"/Type /EmbeddedFile /Subtype /text#2Fplain /Params << /Size 99 /CreationDate (D:2024) >>", docx()),
        6: b"<< /Type /Filespec /F (report.docm) /UF (report.docm) /Desc (A hidden extra) /EF << /F 5 0 R >> >>",
        7: b"<< /EmbeddedFiles << /Names [(a) 6 0 R] >> >>",
        9: stream(b"/Type /Metadata", XMP.replace("Nils Berg", "Owner of the picture").encode()),
    }
    return pdf(objects)


def pdf_encrypted(kind="rc4_128", password=b""):
    """Author in a string encrypted for a user password."""
    id0, author, P = b"\1" * 16, b"Hidden Writer", -44
    pad = (password + pdfcrypt.PAD)[:32]
    if kind in ("aes256r5", "aes256"):
        key, salt, check = bytes(range(32)), b"saltsalt", b"chkchkch"
        digest = (lambda s: hashlib.sha256(password + s).digest()) if kind == "aes256r5" else (lambda s: pdfcrypt.hash_r6(password, s))
        U = digest(check) + check + salt
        UE = pdfcrypt.aes_cbc(digest(salt), bytes(16), key, encrypt=True)
        R, cipher = (5, key) if kind == "aes256r5" else (6, key)
        e = b"<< /Filter /Standard /V 5 /R %d /Length 256 /P %d /O <%s> /U <%s> /UE <%s> /CF << /StdCF << /CFM /AESV3 >> >> /StmF /StdCF /StrF /StdCF >>" % (R, P, bytes(48).hex().encode(), U.hex().encode(), UE.hex().encode())
    else:
        R, n = {"rc4_40": (2, 5), "rc4_128": (3, 16), "aes128": (4, 16)}[kind]
        O = bytes(range(32))  # noqa: E741
        key = hashlib.md5(pad + O + (P & 0xFFFFFFFF).to_bytes(4, "little") + id0).digest()
        for _ in range(50 if R >= 3 else 0):
            key = hashlib.md5(key[:n]).digest()
        key = key[:n]
        if R == 2:
            U = pdfcrypt.rc4(key, pdfcrypt.PAD)
        else:
            U = pdfcrypt.rc4(key, hashlib.md5(pdfcrypt.PAD + id0).digest())
            for i in range(1, 20):
                U = pdfcrypt.rc4(bytes(k ^ i for k in key), U)
            U = U.ljust(32, b"\0")
        cf = b"/CF << /StdCF << /CFM /AESV2 >> >> /StmF /StdCF /StrF /StdCF " if kind == "aes128" else b""
        e = b"<< /Filter /Standard /V %d /R %d /Length %d /P %d /O <%s> /U <%s> %s>>" % ({2: 1, 3: 2, 4: 4}[R], R, n * 8, P, O.hex().encode(), U.hex().encode(), cf)
        salt = b"sAlT" if kind == "aes128" else b""
        cipher = hashlib.md5(key + (3).to_bytes(3, "little") + bytes(2) + salt).digest()[: min(n + 5, 16)]
    if kind.startswith("rc4"):
        secret = pdfcrypt.rc4(cipher, author)
    else:
        n = 16 - len(author) % 16
        secret = b"i" * 16 + pdfcrypt.aes_cbc(cipher, b"i" * 16, author + bytes([n]) * n, encrypt=True)
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 1 >>", 3: b"<< /Author <%s> >>" % secret.hex().encode(), 8: e}
    return pdf(objects, extra=b"/Encrypt 8 0 R ", ids=(id0, id0))


def archive(files, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 2, 3, 4, 6)), data, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
        z.comment = comment
    return out.getvalue()


CORE = '<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:creator>Dora Pell</dc:creator><cp:lastModifiedBy>Lena Voss</cp:lastModifiedBy><dc:title>Plan</dc:title></cp:coreProperties>'


def docx(macros=True):
    files = {
        "[Content_Types].xml": "<Types/>",
        "docProps/core.xml": CORE,
        "docProps/app.xml": "<Properties><Company>Firm</Company><TotalTime>245</TotalTime><Pages>3</Pages></Properties>",
        "docProps/custom.xml": '<Properties><property fmtid="x" pid="2" name="MSIP_Label_77ab_SiteId"><vt:lpwstr>guid</vt:lpwstr></property></Properties>',
        "word/document.xml": '<w:document><w:ins w:id="1" w:author="Legal" w:date="2024-01-01T00:00:00Z"/><w:vanish/></w:document>',
        "word/comments.xml": '<w:comments><w:comment w:id="0" w:author="Dora Pell" w:initials="MO"/></w:comments>',
        "word/people.xml": '<w15:people><w15:person w15:author="Dora Pell"><w15:presenceInfo w15:providerId="AD" w15:userId="S::dora@firm"/></w15:person></w15:people>',
        "word/settings.xml": '<w:settings><w:attachedTemplate r:id="rId1"/><w:rsid w:val="00A1"/></w:settings>',
        "word/_rels/settings.xml.rels": '<Relationships><Relationship Id="rId1" Type="http://x/relationships/attachedTemplate" Target="http://evil.example/t.dotm" TargetMode="External"/></Relationships>',
        "word/_rels/document.xml.rels": '<Relationships><Relationship Id="rId2" Type="http://x/relationships/image" Target="\\\\srv\\share\\a.png" TargetMode="External"/></Relationships>',
        "word/media/image1.jpg": jpeg(),
    }
    if macros:
        files["word/vbaProject.bin"] = b"vba"
    return archive(files)


def xlsx():
    return archive(
        {
            "[Content_Types].xml": "<Types/>",
            "docProps/core.xml": CORE,
            "xl/workbook.xml": '<workbook><x15ac:absPath url="C:\\Users\\dora\\" xmlns:x15ac="x"/><sheets><sheet name="Open" sheetId="1"/><sheet name="Salaries" sheetId="2" state="hidden"/></sheets></workbook>',
            "xl/connections.xml": '<connections><connection id="1" name="c"><dbPr connection="Server=db77.firm.local"/></connection></connections>',
            "xl/comments1.xml": "<comments><authors><author>Pia of accounts</author></authors></comments>",
        }
    )


def pptx():
    return archive({"[Content_Types].xml": "<Types/>", "docProps/core.xml": CORE, "ppt/slides/slide1.xml": "<a/>", "ppt/slides/slide2.xml": "<a/>", "ppt/notesSlides/notesSlide1.xml": "<a/>", "ppt/commentAuthors.xml": '<p:cmAuthorLst><p:cmAuthor id="0" name="Owner" initials="O"/></p:cmAuthorLst>'})


def odt():
    meta = '<office:document-meta><office:meta><meta:generator>LO 7</meta:generator><meta:initial-creator>Otto K</meta:initial-creator><meta:editing-duration>PT2H30M5S</meta:editing-duration><meta:template xlink:href="/home/otto/t.ott" xlink:title="t"/><meta:user-defined meta:name="Client">Gamma Ltd</meta:user-defined></office:meta></office:document-meta>'
    return archive({"mimetype": "application/vnd.oasis.opendocument.text", "meta.xml": meta, "Basic/Standard/Module1.xml": "<x/>", "Pictures/1.jpg": jpeg()})


def epub():
    return archive({"mimetype": "application/epub+zip", "OEBPS/content.opf": '<package><metadata><dc:creator>A Writer</dc:creator><dc:title>Book</dc:title><meta name="generator" content="Maker 7"/></metadata></package>'})


def jar():
    return archive({"META-INF/MANIFEST.MF": "Manifest-Version: 1.0\r\nBuilt-By: builder-7\r\n", "a.class": b"x"})


def plain_zip():
    return archive({"invoice.pdf.exe": b"MZ", "photo.jpg": jpeg(), "../up.txt": b"x"}, b"an archive remark")


def ole(streams):
    """A compound file with 512-byte sectors; streams are padded to 4096 bytes so that none needs the small table."""
    sector, chains, data, at = 512, [], b"", 0
    names = list(streams)
    for n in names:
        d = streams[n].ljust(4096, b"\0")
        d += bytes(-len(d) % sector)
        chains.append((at, len(d)))
        data += d
        at += len(d) // sector
    entry = lambda name, kind, child, right, start, size: (name.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBBIII", 2 * len(name) + 2, kind, 1, 0xFFFFFFFF, right, child) + bytes(36) + struct.pack("<III", start, size, 0)
    directory = entry("Root Entry", 5, 1, 0xFFFFFFFF, 0xFFFFFFFE, 0)
    for i, n in enumerate(names):
        directory += entry(n, 2, 0xFFFFFFFF, i + 2 if i + 1 < len(names) else 0xFFFFFFFF, chains[i][0], chains[i][1])
    directory += bytes(-len(directory) % sector)
    dir_at, dir_n = at, len(directory) // sector
    fat_at = at + dir_n
    fat = [0xFFFFFFFF] * 128
    for start, size in [*chains, (dir_at * 1, len(directory))]:
        for k in range(size // sector):
            fat[start + k] = start + k + 1 if k + 1 < size // sector else 0xFFFFFFFE
    fat[fat_at] = 0xFFFFFFFD
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, 1, dir_at, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<I", fat_at) + b"\xff" * (4 * 108)
    return head + data + directory + struct.pack("<128I", *fat)


def doc():
    values = {1: (2, struct.pack("<HH", 1252, 0)), 4: (0x1E, struct.pack("<I", 11) + b"Old Author\0\0"), 8: (0x1E, struct.pack("<I", 5) + b"Anna\0\0\0\0"), 12: (0x40, struct.pack("<Q", (1704067200 + 11644473600) * 10**7)), 14: (3, struct.pack("<I", 7))}
    at, table, body = 8 + 8 * len(values), b"", b""
    for id, (kind, raw) in values.items():
        table += struct.pack("<II", id, at + len(body))
        body += struct.pack("<I", kind) + raw
    section = struct.pack("<II", 8 + len(table) + len(body), len(values)) + table + body
    summary = struct.pack("<HHI", 0xFFFE, 0, 2) + bytes(16) + struct.pack("<I", 1) + bytes(16) + struct.pack("<I", 48) + section
    return ole({"WordDocument": b"x", "\5SummaryInformation": summary, "Macros": b"m"})


def msg():
    u = lambda s: s.encode("utf-16-le")
    return ole({"__properties_version1.0": b"x", "__substg1.0_0037001F": u("Hello"), "__substg1.0_0C1A001F": u("A Sender"), "__substg1.0_007D001F": u("Received: from 10.1.2.3")})


BUILDERS = {
    "a.jpg": jpeg,
    "b.png": png,
    "c.webp": webp,
    "d.tif": tiff,
    "f.gif": gif,
    "g.heic": heic,
    "s.svg": lambda: SVG.encode(),
    "j.pdf": pdf_plain,
    "k.pdf": pdf_rich,
    "m.docm": docx,
    "n.xlsx": xlsx,
    "o.pptx": pptx,
    "p.odt": odt,
    "q.epub": epub,
    "r.jar": jar,
    "t.zip": plain_zip,
    "u.doc": doc,
    "u.msg": msg,
    "v.wav": wav,
    "x.m4a": m4a,
    "y.flac": flac,
    "z.mp3": mp3,
    "za.opus": opus,
    "zb.mkv": mkv,
    "zc.avi": avi,
    "zd.mov": mov,
    "bmp.bmp": lambda: b"BM" + struct.pack("<IIIIiiHHIIiiII", 70, 0, 54, 40, 3, -2, 1, 24, 0, 16, 2835, 2835, 0, 0) + bytes(16),
    "i.ico": lambda: b"\0\0\1\0\2\0" + bytes([16, 16]) + bytes(14) + bytes([0, 0]) + bytes(14),
} | {f"enc_{k}.pdf": partial(pdf_encrypted, k) for k in ("rc4_40", "rc4_128", "aes128", "aes256r5", "aes256")} | {"enc_userpw.pdf": partial(pdf_encrypted, "rc4_128", b"secret")}


@cache
def sample(name: str) -> bytes:
    return BUILDERS[name]()


def __getattr__(name: str):
    """FILES: all samples by name, made when they are asked for."""
    if name == "FILES":
        return {n: sample(n) for n in BUILDERS}
    raise AttributeError(name)
