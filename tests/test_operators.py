"""Functions and operators on small cases: detection alike in both forms, parts, dictionary, exports, store, streaming."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from filegrain.functions import native as N
from filegrain.operators import relational as R
from filegrain.operators import render
from filegrain.operators.extract.detect import mpeg_frame, sniff
from filegrain.sources import pages, plan
from filegrain.sources.store import TransferStore

from .fixtures import FILES


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_sniff_is_the_same_natively(spark):
    heads = dict(FILES) | {"a": b"", "b": b"ab", "c": b"\0\0\0\x20wide", "d": b"\xff\xfb\x90\x64" + bytes(9), "e": b"\xff\xff\xff\xff\xff", "f": b"RIFFxxxxJUNK", "g": b"x" * 900 + b"%PDF-1.4", "h": b"x" * 2000 + b"%PDF-1.4", "i": b"  <?xml version='1'?>" + b" " * 3000 + b"<SVG >", "j": b"ID3\4\0\0\0\0\0\3abcfLaC", "k": b"BM" + b"\xff" * 40, "l": b"\0\0\0\x1cftypavif\0\0\0\0avifmif1", "m": b"\0\0\0\x1cftypisom\0\0\0\0avif", "n": b"\0\0\0\x18ftypmif1\0\0\0\0heic", "o": b"\0\0\0\x14ftyp3gp4", "p": b"\0\0\0\x14ftypcrx "}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in heads.items()], "name string, content binary")
    assert {r["name"]: r["t"] for r in df.select("name", N.sniff("content").alias("t")).collect()} == {k: sniff(v) for k, v in heads.items()}


def test_sniff_is_native(spark):
    df = spark.createDataFrame([(bytearray(b"x"),)], "content binary")
    text = df.select(N.sniff("content"), N.mime_mismatch(N.sniff("content"), F.lit("image/png")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text


def test_mpeg_header_is_the_same_natively(spark):
    for b in (b"\xff\xfb\x90\x64", b"\xff\xf3\x48\xc4", b"\xff\xe3\x18\xc4", b"\xff\xff\x14\x04", b"\xff\xfd\xa4\x44"):
        got, want = one(spark, N.mpeg_header(F.lit(bytearray(b))).alias("h"))["h"], mpeg_frame(b, 0)
        assert (got["version"], got["layer"], got["kbps"], got["hz"], got["mode"], got["samples"]) == tuple(want[k] for k in ("version", "layer", "kbps", "hz", "mode", "samples"))


@pytest.mark.parametrize(
    ("url", "name"),
    [("https://h.example/a/b%20c.jpg?x#y", "b c.jpg"), ("https://h.example/a/", "a"), ("https://h.example", "h.example"), ("data:image/png;base64,xx", "data: URL"), ("blob:https://h/1", "blob: URL"), ("not a url", "not a url"), ("https://h/a+b", "a+b"), ("https://h/%zz", "%zz"), ("file:/tmp/x.pdf", "x.pdf")],
)
def test_name_from_url(spark, url, name):
    assert one(spark, N.name_from_url(F.lit(url)).alias("n"))["n"] == name


def test_small_functions(spark):
    r = one(
        spark,
        N.pdf_date(F.lit("D:20240102")).alias("date"),
        N.iso6709(F.lit("no")).alias("no"),
        N.mac_date(F.lit(1)).alias("mac"),
        N.clean_name(F.lit("a/b.tar.gz")).alias("clean"),
        N.clean_name(F.lit("x"), F.lit("jpg")).alias("given"),
        N.duration_text(F.lit(3723.5)).alias("long"),
        N.data_url_bytes(F.lit("data:,a%20b")).alias("plain"),
        N.severity(F.lit(None).cast("array<struct<level:string>>")).alias("none"),
        N.retriable(F.lit(407)).alias("again"),
        N.packed_language(F.lit((21 << 10) | (14 << 5) | 4)).alias("und"),
    )
    assert r["date"] == "2024-01-02 00:00:00" and r["no"] is None and r["mac"] is None and r["clean"] == "a_b.tar-clean.gz" and r["given"] == "x-clean.jpg"
    assert r["long"] == "1:02:03.50" and bytes(r["plain"]) == b"a b" and r["none"] == -1 and r["again"] and r["und"] is None


def test_parts_alike_in_all_forms(spark):
    parts = [(-5, 3), (3, 5), (9, 9), (20, 40), (7, 8), (30, 35), (38, 99), (5, 6)]
    want = plan.merged(parts, 50)
    assert want == [(0, 6), (7, 8), (20, 50)]
    df = spark.createDataFrame([("f", s, e, 50) for s, e in parts], "file string, s long, e long, size long")
    assert sorted((r["s"], r["e"]) for r in R.merge_parts(df, "file", size="size").collect()) == want


def test_dictionary(spark):
    exact, patterns = {"Ad": "Name", "Boyut": "Size"}, [(r"^(\d+) kanal$", "$1 channels")]
    t = lambda s: one(spark, R.translated(F.lit(s), exact, patterns).alias("t"))["t"]
    assert [t(x) for x in ("Ad", "2 kanal", "Ad · Boyut · x", "other")] == ["Name", "2 channels", "Name · Size · x", "other"]
    assert one(spark, R.filled(F.lit("{} of {} ({})"), F.array(F.lit("a"), F.lit(None).cast("string"))).alias("t"))["t"] == "a of  ()"


def test_turkish_search(spark):
    rows = spark.createDataFrame([("1", "k", "ISPARTA", "t"), ("2", "k", "istanbul", "t"), ("3", "k", "İzmir", "t")], "file_id string, k string, v string, section_title string")
    assert [r["file_id"] for r in R.field_search(rows, "ı").collect()] == ["1"]
    assert [r["file_id"] for r in R.field_search(rows, "İ").collect()] == ["2", "3"]


PAGE = """<img src="/a.png"><img src='b.jpg' width=9><video src="v.mp4"></video><a href="doc.pdf?x=1">d</a><a href="/page">no</a><a href="https://o.example/x.DOCX">x</a>
<div style="background:url('bg.gif')"></div><a href="/a.png">again</a><a href="javascript:x">j</a><audio><source src="//cdn.example/s.webm"></audio><picture><source src="no.webm"></picture><img src=tiny.png width=9 height="9">"""


def test_page_items(spark):
    df = spark.createDataFrame([(1, "https://h.example/dir/p.html?q", PAGE)], "page_id long, url string, html string")
    got = [(r["kind"], r["url"]) for r in pages.page_items(df).orderBy("ord").collect()]
    assert got == [("img", "https://h.example/a.png"), ("img", "https://h.example/dir/b.jpg"), ("media", "https://h.example/dir/v.mp4"), ("media", "https://cdn.example/s.webm"), ("link", "https://h.example/dir/doc.pdf?x=1"), ("link", "https://o.example/x.DOCX"), ("bg", "https://h.example/dir/bg.gif")]
    size = one(spark, pages.large_enough(F.lit(20), F.lit(20)).alias("a"), pages.large_enough(F.lit(20), F.lit(60)).alias("b"), pages.large_enough(F.lit(None).cast("int"), F.lit(None).cast("int")).alias("c"))
    assert tuple(size) == (False, True, True)


def test_exports(spark, tmp_path):
    from filegrain.operators.extraction import extract

    df = spark.createDataFrame([(k, bytearray(FILES[k]), f"https://h/{k}") for k in ("a.jpg", "k.pdf", "s.svg")], "file_id string, content binary, url string")
    reports = extract(df).withColumn("item_seq", F.monotonically_increasing_id()).cache()
    html = reports.where("file_id = 's.svg'").select(render.as_html(F.lit("now")).alias("h")).first()["h"]
    assert "<script" not in html and "T &amp; t" in html and "&lt;script&gt; tags" in html
    text = reports.where("file_id = 'a.jpg'").select(render.as_text().alias("t")).first()["t"]
    assert text.startswith("a.jpg — JPEG\n") and "[danger] Contains GPS location" in text and "\n\n## File\nName: a.jpg" in text
    assert json.loads(reports.select(render.as_json("file_id", "info")).first()[0])["info"]["type_label"]
    state = reports.withColumn("url", F.col("file_id")).withColumn("error", F.lit(None).cast("string"))
    render.write_csv(state, f"{tmp_path}/csv")
    body = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part-*")))
    lines = body.decode().split("\r\n")
    assert lines[0] == '﻿"url","type","size","gps_lat","gps_lon","warnings","highlights","error"' and len(lines) == 5 and lines[1].startswith('"a.jpg","JPEG",')
    for kind in ("json", "text", "html"):
        render.write_reports(reports, f"{tmp_path}/{kind}", kind)


def test_cleaned_sink(spark, tmp_path):
    from filegrain.operators.cleaning import clean_files

    df = spark.createDataFrame([("1", bytearray(FILES["a.jpg"])), ("2", bytearray(FILES["zb.mkv"]))], "file_id string, content binary")
    render.write_cleaned(clean_files(df), spark.createDataFrame([("1", "my photo.jpg"), ("2", "x.mkv")], "file_id string, name string"), f"{tmp_path}/out")
    assert [r["name"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["my photo-clean.jpg"]


def test_summaries(spark):
    f = lambda level, text: {"code": "c", "level": level, "text": text}
    rows = [(1, [f("danger", "PDF contains JavaScript"), f("warn", "Contains author name")], {"lat": 1.0, "lon": 2.0}, None), (2, [f("info", "x")], None, None), (3, None, None, "HTTP 404"), (4, None, None, None)]
    df = spark.createDataFrame(rows, "item_seq long, flags array<struct<code:string,level:string,text:string>>, gps struct<lat:double,lon:double>, error string")
    assert tuple(R.scan_summary(df).first()) == (3, 4, 1, 1, 1, 1)
    assert [r["item_seq"] for r in R.ranked(df).collect()] == [1, 2, 3, 4]
    assert [r["item_seq"] for r in R.findings_only(df).collect()] == [1]


def test_store(spark, tmp_path):
    store, t = TransferStore(spark, f"{tmp_path}/store"), datetime.datetime(2024, 1, 1, 12, tzinfo=datetime.UTC)
    put = lambda k, v, at: store.put(spark.createDataFrame([(k, bytearray(v))], "key string, blob binary"), at)
    put("a", b"1", t)
    put("a", b"2", t + datetime.timedelta(minutes=1))
    put("b", b"3", t)
    put("c", b"4", t)
    store.delete(spark.createDataFrame([("b",)], "key string"), t + datetime.timedelta(minutes=2))
    assert {r["key"]: bytes(r["blob"]) for r in store.get(["a", "b", "c"]).collect()} == {"a": b"2", "c": b"4"}
    fresh = TransferStore(spark, store.prune(t + datetime.timedelta(minutes=60, seconds=30)))
    assert [r["key"] for r in fresh.rows().collect()] == ["a"]


def test_streams(spark, tmp_path):
    from filegrain.streaming.tabs import badges, progressive, tab_state

    events = [(1, "u1", "image/png", False, 1), (1, "u2", "text/html", False, 2), (2, "u", "video/mp4", False, 1), (3, "u", "image/png", False, 1), (3, "u", None, True, 5)]
    src = f"{tmp_path}/events"
    spark.createDataFrame(events, "tab_id long, url string, mime string, closed boolean, ts long").write.parquet(src)
    stream = spark.readStream.schema("tab_id long, url string, mime string, closed boolean, ts long").parquet(src)
    q = tab_state(stream).writeStream.format("memory").queryName("tab_states").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("tab_states").collect()] == [(2, "u", "video/mp4")]

    flags = [{"code": "c", "level": "danger", "text": "t"}]
    schema = "tab_id long, mime string, flags array<struct<code:string,level:string,text:string>>, item_seq long, gps struct<lat:double>, error string"
    spark.createDataFrame([(1, "application/pdf", flags, 1, None, None), (2, "image/png", [], 2, None, None)], schema).write.parquet(f"{tmp_path}/results")
    results = spark.readStream.schema(schema).parquet(f"{tmp_path}/results")
    assert results.isStreaming and badges(results).isStreaming
    seen = []
    progressive(results, lambda rows, summary, n: seen.append(([r["tab_id"] for r in rows.collect()], summary.first()["done"])), f"{tmp_path}/cp").awaitTermination()
    assert seen == [([1, 2], 2)]
    assert [tuple(r) for r in badges(spark.read.parquet(f"{tmp_path}/results")).orderBy("tab_id").collect()] == [(1, "PDF!", "red"), (2, "IMG", "green")]
