"""What reports say of files of each format; cleaning leaves none of it."""

import random
import re
import time

import pytest

from filegrain import catalog
from filegrain.operators import cleaning
from filegrain.operators.extract import pdfcrypt
from filegrain.operators.extract.binary import duration_text
from filegrain.operators.extract.detect import sniff
from filegrain.operators.extraction import analyse, extract, metadata_rows, register_extractor

from .fixtures import FILES


def flat(r: dict) -> str:
    out = [f"TYPE {r['info']['type_label']}", f"THUMB {'yes' if r['thumbnail'] else 'no'}"]
    if r["gps"]:
        out.append(f"GPS {r['gps']['lat']:g},{r['gps']['lon']:g}")
    out += [f"FLAG {f['level']}:{f['text']}" for f in r["flags"]] + [f"WARN {w}" for w in r["warnings"]] + [f"HL {h}" for h in r["highlights"]]
    for s in r["sections"]:
        out += [f"## {s['title']}"] + [f"{x['k']} = {x['v']}" for x in s["rows"]]
    return "\n".join(out)


GPS = r"GPS 60\.393,5\.3242"
EXPECTED = {
    "a.jpg": ["TYPE JPEG", "Make = Optika", GPS, "FLAG danger:Contains GPS", "SerialNumber = 987654", "City = Bergen", "dc:creator = Nils Berg", r"Comment \(COM\) = a hidden comment", "Data after EOI = 130 B", "Orientation = Rotated 90° CW", "4:2:0", "Density = 72 × 72 dpi", "Segments = APP0 JFIF, APP1 Exif", "ExposureTime = 1/250 s"],
    "b.png": ["GPS -40,-10", "Author = Lena", "dc:title = A title", "comment = hello", "72 × 72 dpi", "2024-01-02 03:04:05 UTC", "AI generation", "Data after IEND", r"Chunks = IHDR, pHYs, tIME, tEXt×2"],
    "c.webp": [GPS, "LensModel = ZM24-105mm", "Features = EXIF, XMP", "dc:creator"],
    "d.tif": ["TYPE TIFF", "Make = Optika", "## TIFF · Image"],
    "f.gif": ["Comment = gif remark", "Frame count = 1", "Loop = Infinite", "NETSCAPE2.0, XMP DataXMP"],
    "g.heic": [GPS, "TYPE HEIF", "Make = Optika", "Pixel dimensions = 4000 × 3000"],
    "s.svg": ["sodipodi:docname = secret.svg", "export-filename = /Users/nils", "FLAG danger:SVG contains scripts/event handlers .2.", "FLAG danger:SVG contains a javascript", "dc:creator = Nils", "Illustrator", "title = T & t"],
    "j.pdf": ["Title = Übersicht", r"Author = Can \(test\) é", "dc:creator = Nils Berg", "FLAG danger:PDF contains JavaScript", "FLAG danger:PDF names obfuscated", r"Revisions \(incremental updates\) = 2", "— A4", "Creation date = 2024-01-02 03:04:05 .03:00", "Modification date = 2024-02-03 03:04:05 UTC", "Page count = 2", "FLAG info:Document ID pair", "Fonts = AB"],
    "k.pdf": [r"Embedded file · PDF image obj 4 \(640×480\)", GPS, "FLAG danger:Embedded images contain GPS", "report.docm = 99 B · text/plain · A hidden extra · created 2024-01-01", "Object XMP · obj 9", "Owner of the picture", "Embedded file · attachment: report.docm", "Dora Pell", "Author = Info author", "FLAG danger:Executable/macro attachment", "PieceInfo"],
    "m.docm": [r"TYPE DOCX \(with macros\)", r"Author \(creator\) = Dora Pell", "Last modified by = Lena Voss", "Company = Firm", r"Total editing time = 245 min \(4:05\)", "MSIP_Label_77ab_SiteId", "FLAG danger:Contains macros", "FLAG danger:Remote attachedTemplate", "FLAG danger:External UNC", "Tracked-change authors = Legal", "Comment authors = Dora Pell", "S::dora@firm", "hidden .vanish. text", GPS],
    "n.xlsx": [r"Original save folder = C:\\Users\\dora", r"Salaries \[hidden\]", "Pia of accounts", r"db77\.firm\.local", "FLAG warn:Contains 1 hidden worksheet"],
    "o.pptx": ["TYPE PPTX", "Comment authors = Owner", "Slides / speaker notes = 2 / 1"],
    "p.odt": ["TYPE ODT", "Initial author = Otto K", "2:30:05", "Template = /home/otto", "Client = Gamma Ltd", "FLAG danger:Contains macros/scripts", GPS],
    "q.epub": ["dc:creator = A Writer", "generator = Maker 7", "TYPE EPUB"],
    "r.jar": ["Built-By = builder-7", "TYPE JAR"],
    "t.zip": ["FLAG danger:Contains executable", "Archive comment = an archive remark", GPS, "zip slip"],
    "u.doc": [r"TYPE DOC \(Word 97-2003\)", "Author = Old Author", "Last saved by = Anna", "Created = 2024-01-01 00:00:00 UTC", "macros"],
    "u.msg": ["TYPE MSG", "Subject = Hello", "Sender name = A Sender", "10.1.2.3"],
    "v.wav": [r"Title \(INAM\) = A title", r"Software \(ISFT\) = Editor1", "BWF originator = Recorder 9", "Duration = 0:02", "PCM · 2 channels · 44100 Hz · 16 bit"],
    "x.m4a": [r"Title \(©nam\) = Episode 1", GPS, "THUMB yes", "iTunes:NOTE = x"],
    "y.flac": ["TITLE = A track", "ENCODED_BY = Some PC", "FLAC · 44100 Hz · 2 channels · 16 bit", "Duration = 0:02", "THUMB yes"],
    "z.mp3": [r"Title \(TIT2\) = Şarkı", r"Comment \(COMM\) about \[eng\] = hidden remark", "TXXX:Recorder = Room 5", r"Private data: www\.shop\.test = \[9 B\]", "THUMB yes", "MPEG-1 Layer III", GPS, "V1 title", "Track = 5", "128 kbps"],
    "za.opus": ["TITLE = A recording", "Opus · 2 channels", "Duration = 2:05", "TYPE OGG Opus"],
    "zb.mkv": [r"WritingApp = Muxer 3\.1", "2024-01-01 00:00:00 UTC", "V_MPEG4/ISO/AVC · 1920×1080", "ENCODER = Coder 60", r"Attachment: font\.ttf", r"Duration = 1:33\.50", "TYPE MKV"],
    "zc.avi": [r"Software \(ISFT\) = CamMVI_007", r"Capture date \(IDIT\)", "640", "TYPE AVI", "Duration = 0:10"],
    "zd.mov": ["GPS 60.3913,5.3221", "quicktime.model = Phone 15", r"Video · avc1 · 1920×1080", r"Creation time \(mvhd\) = 2024-01-01 00:00:00 UTC", "Duration = 0:42", r"Software \(©swr\) = Soft 1\.41", "TYPE MOV", "eng"],
    "bmp.bmp": ["Pixel dimensions = 3 × 2", "Bits/pixel = 24", "72 dpi"],
    "i.ico": ["Image count = 2", "Sizes = 16×16, 256×256"],
    "enc_rc4_40.pdf": ["Author = Hidden Writer", r"RC4 \(R2\)", "fields decrypted"],
    "enc_rc4_128.pdf": ["Author = Hidden Writer", r"RC4 \(R3\)"],
    "enc_aes128.pdf": ["Author = Hidden Writer", r"AES-128 \(R4\)"],
    "enc_aes256r5.pdf": ["Author = Hidden Writer", r"AES-256 \(R5\)"],
    "enc_aes256.pdf": ["Author = Hidden Writer", r"AES-256 \(R6\)"],
    "enc_userpw.pdf": ["user password is required"],
}


@pytest.mark.parametrize("name", FILES)
def test_report(name):
    report = flat(analyse(FILES[name], {"name": name}))
    assert not [p for p in EXPECTED[name] if not re.search(p, report)], report
    assert "Parse error" not in report


FORBIDDEN = {
    "a.jpg": "Optika|GPS|Bergen|Nils Berg|hidden comment|after EOI",
    "b.png": "GPS|Lena|A title|hello|tIME|after IEND",
    "c.webp": "GPS|LensModel|dc:creator",
    "f.gif": "gif remark|XMP Data",
    "g.heic": "GPS|Optika",
    "s.svg": "docname|/Users|Nils|Illustrator",
    "j.pdf": "Author|Übersicht|Nils Berg",
    "k.pdf": "Info author|Owner of the picture",
    "m.docm": "Dora|Lena|Firm|245|MSIP|Legal|S::|GPS|evil",
    "n.xlsx": "Users|Pia of|Dora",
    "o.pptx": "Owner|Dora",
    "p.odt": "Otto|Gamma|GPS|2:30:05",
    "v.wav": "A title|Editor1|Recorder 9",
    "x.m4a": "Episode|GPS|THUMB yes",
    "y.flac": "A track|Some PC|THUMB yes",
    "z.mp3": "Şarkı|remark|Room|shop|V1 title|GPS",
    "zd.mov": "GPS|Phone 15|Soft 1|2024",
}


@pytest.mark.parametrize("name", FORBIDDEN)
def test_cleaned(name):
    out = cleaning.clean(FILES[name])
    report = flat(analyse(out["bytes"], {"name": "x"}))
    assert not re.search(FORBIDDEN[name], report), report
    assert "truncated" not in report and "Parse error" not in report
    assert out["removed"] and sniff(out["bytes"]) == out["type"]
    if out["type"] in ("pdf", "mov", "m4a", "heif"):
        assert len(out["bytes"]) == len(FILES[name])


def test_orientation_is_kept():
    out = cleaning.clean(FILES["a.jpg"])
    assert "Orientation = Rotated 90° CW" in flat(analyse(out["bytes"], {}))
    assert any("Orientation" in n for n in out["notes"])


@pytest.mark.parametrize("name", ["q.epub", "zb.mkv", "u.doc", "enc_rc4_40.pdf", "za.opus", "d.tif"])
def test_refused(name):
    with pytest.raises(cleaning.CleanError):
        cleaning.clean(FILES[name])


def test_damaged_files_never_fail():
    for name, b in FILES.items():
        for cut in (5, len(b) // 3, len(b) // 2, len(b) - 3):
            analyse(b[:cut], {"name": name, "type": sniff(b)})
            try:
                cleaning.clean(b[:cut])
            except (cleaning.CleanError, ValueError, IndexError, KeyError):
                pass


def test_ciphers():
    key = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c")
    block = bytes.fromhex("6bc1bee22e409f96e93d7e117393172a")
    assert pdfcrypt._encrypt_block(pdfcrypt._round_keys(key), block).hex() == "3ad77bb40d7a3660a89ecaf32466ef97"
    assert pdfcrypt.aes_cbc(key, bytes(16), pdfcrypt.aes_cbc(key, bytes(16), block * 3, encrypt=True)) == block * 3
    assert pdfcrypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


def test_aes_by_the_library_is_the_same_as_here(monkeypatch):
    r = random.Random(5)
    for n in [*range(50), 4096]:
        for size in (16, 24, 32):
            key, iv, data = r.randbytes(size), r.randbytes(16), r.randbytes(n)
            for encrypt in (True, False):
                fast = pdfcrypt.aes_cbc(key, iv, data, encrypt)
                with monkeypatch.context() as m:
                    m.setattr(pdfcrypt, "_openssl", lambda: None)
                    assert pdfcrypt.aes_cbc(key, iv, data, encrypt) == fast


def test_documents_of_revision_6_take_little_time():
    """Each takes two hashes of some 70 rounds of AES over 2 to 4 KiB."""
    began = time.process_time()
    for _ in range(20):
        assert analyse(FILES["enc_aes256.pdf"], {"type": "pdf"})["info"]["encrypted"]
    assert time.process_time() - began < 5


def test_sample_files_are_dealt_to_all_cores(spark):
    assert catalog.queries()["e09i_encryption"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_durations():
    assert [duration_text(x) for x in (2, 125, 93.5, 42, 3723)] == ["0:02", "2:05", "1:33.50", "0:42", "1:02:03"]


def test_stage_over_files(spark, tmp_path):
    from filegrain.plans.scan import clean_and_verify
    from filegrain.sources.files import read_files

    for name, b in FILES.items():
        (tmp_path / name).write_bytes(b)
    (tmp_path / "odd.bin").write_bytes(b"ab")
    files = read_files(spark, str(tmp_path))
    before, cleaned, checks = clean_and_verify(files)
    reports = {r["info"]["name"]: r for r in before.collect()}
    assert len(reports) == len(FILES) + 1
    for name in FILES:
        r = reports[name]
        text = flat(r.asDict(recursive=True))
        assert not [p for p in EXPECTED[name] if not re.search(p, text)], text
    assert "Unrecognized" in reports["odd.bin"]["warnings"][0]
    done = {r["file_id"].rpartition("/")[2]: r for r in cleaned.collect()}
    assert done["a.jpg"]["error"] is None and "not supported" in done["zb.mkv"]["error"]
    gone = {(r["file_id"].rpartition("/")[2], r["code"]): r["removed"] for r in checks.collect()}
    assert gone["a.jpg", "gps"] and gone["z.mp3", "gps"] and not gone["s.svg", "svg-script"]
    rows = metadata_rows(before)
    assert rows.where("k = 'Make' AND v = 'Optika'").count() >= 4
    assert {r["label"] for r in cleaning.removal_log(cleaned).collect()} >= {"XMP", "EXIF (camera, GPS, date, thumbnail)"}


def test_transport_details(spark):
    df = spark.createDataFrame([("x", bytearray(FILES["a.jpg"]), "image/png; q=1", {"server": "s", "last-modified": "Mon"}, "https://h/p.jpg")], "file_id string, content binary, content_type string, headers map<string,string>, url string")
    text = flat(extract(df).first().asDict(recursive=True))
    assert 'Content type mismatch: the server says "image/png"' in text and "server = s" in text and "Server date: Mon" in text and "Name = p.jpg" in text


def test_registered_extractor(spark):
    def parse(b, R):
        R.section("mine", "Mine").add("size", len(b))

    register_extractor("mine", parse, "My type")
    df = spark.createDataFrame([("x", bytearray(b"abcdef"), "mine")], "file_id string, content binary, type string")
    r = extract(df).first()
    assert r["info"]["type_label"] == "My type" and any(s["id"] == "mine" for s in r["sections"])
