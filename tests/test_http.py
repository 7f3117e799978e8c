"""Range reads against a local server: how much is read, and that reports of partial content are right."""

import http.server
import json
import struct
import threading

import pytest

from filegrain.operators.extraction import analyse, extract
from filegrain.sources.http_range import HttpRangeSource, UrlSource, fetch
from filegrain.sources.plan import MB

from .fixtures import FILES, box, heic


def padded():
    mov = FILES["zd.mov"]
    split = mov.rindex(b"mdat") - 4
    pad = 100 * MB
    stills = heic()
    # The item's offset is absolute, so the padding goes to the end.
    return {
        "small.jpg": FILES["a.jpg"],
        "big.pdf": FILES["k.pdf"].replace(b"trailer\n", b"%" + b" " * pad + b"\ntrailer\n", 1),
        "big.mov": mov[:split] + struct.pack(">I", pad + 8) + b"mdat" + bytes(pad),
        "big.heic": stills + box(b"free", bytes(pad)),
    }


BODIES = padded()


class Handler(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        name = self.path.rpartition("/")[2]
        if self.path.startswith("/guarded/") and not self.headers.get("Referer"):
            self.send_error(403)
            return
        body = BODIES.get(name)
        if body is None:
            self.send_error(404)
            return
        span = self.headers.get("Range")
        if span and not self.path.startswith("/plain/"):
            a, z = (int(x) for x in span.removeprefix("bytes=").split("-"))
            part = body[a : z + 1]
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {a}-{a + len(part) - 1}/{len(body)}")
        else:
            part = body
            self.send_response(200)
        self.send_header("Content-Length", str(len(part)))
        self.send_header("Content-Type", "application/octet-stream")
        self.end_headers()
        try:
            self.wfile.write(part)
        except BrokenPipeError:
            pass

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def base():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.mark.parametrize(("name", "most"), [("big.pdf", 30 * MB), ("big.mov", MB), ("big.heic", MB)])
def test_only_metadata_is_read(base, name, most):
    row = fetch(f"{base}/x/{name}")
    assert row["error"] is None and row["bytes_read"] < most and row["partial"]["total"] == len(BODIES[name])
    r = analyse(row["content"], row | {"name": name})
    assert r["gps"] and not any(k["k"] == "SHA-256" for s in r["sections"] for k in s["rows"])
    assert any("Large file" in w for w in r["warnings"])


def test_small_file_without_ranges(base):
    source = UrlSource(f"{base}/plain/small.jpg").open()
    assert source.read_all() == BODIES["small.jpg"] and source.requests == 1


def test_refusal_missing_and_referer(base):
    assert "HTTP 404" in fetch(f"{base}/x/none")["error"]
    assert "HTTP 403" in fetch(f"{base}/guarded/small.jpg")["error"]
    row = fetch(f"{base}/guarded/small.jpg", referer="https://page.example/")
    assert row["via_background"] and row["content"] == BODIES["small.jpg"]


def test_data_source(spark, base):
    spark.dataSource.register(HttpRangeSource)
    urls = [f"{base}/x/{n}" for n in ("small.jpg", "big.mov", "none")]
    df = spark.read.format("http_range").option("urls", json.dumps(urls)).load()
    rows = {r["url"].rpartition("/")[2]: r for r in df.collect()}
    assert rows["none"]["error"] and rows["big.mov"]["partial"]["total"] == len(BODIES["big.mov"]) and rows["small.jpg"]["partial"] is None
    got = {r["info"]["name"]: r["gps"] for r in extract(df.where("content IS NOT NULL").withColumnRenamed("url", "file_id").drop("name").selectExpr("*", "file_id AS url")).collect()}
    assert got["small.jpg"] and got["big.mov"]


def test_urls_of_any_kind(spark, base, tmp_path):
    import base64

    from filegrain.sources.open import read_urls

    (tmp_path / "b.png").write_bytes(FILES["b.png"])
    data = "data:image/svg+xml;base64," + base64.b64encode(FILES["s.svg"]).decode()
    urls = [f"{tmp_path}/b.png", f"{base}/x/small.jpg", f"{base}/x/none", data, "blob:https://h/1"]
    df = read_urls(spark, urls)
    rows = {r["name"] or r["url"]: r for r in df.collect()}
    assert len(rows) == 5 and "404" in rows["none"]["error"] and "in-page" in rows["blob:https://h/1"]["error"]
    kinds = {r["info"]["type"] for r in extract(df.where("content IS NOT NULL")).collect()}
    assert kinds == {"png", "jpeg", "svg"}
    assert read_urls(spark, []).count() == 0


def test_table_of_urls(spark, base, tmp_path):
    from filegrain.sources.open import read_url_table

    (tmp_path / "b.png").write_bytes(FILES["b.png"])
    urls = [f"{base}/x/small.jpg"] * 3 + [f"{base}/x/none", f"{tmp_path}/b.png", f"file:{tmp_path}/b.png", f"{tmp_path}/no.png", "blob:https://h/1", "data:text/plain,a%20b", None]
    df = read_url_table(spark.createDataFrame([(u, 1) for u in urls], "link string, url int").repartition(3), "link")
    rows = df.collect()
    assert len(rows) == 9 and sum(r["content"] is not None for r in rows) == 6 and sum(bool(r["error"]) for r in rows) == 3
    assert {bytes(r["content"]) for r in rows if r["url"].startswith("data:")} == {b"a b"}


def big_files():
    """Files above a limit of 1 MB: ones that are read in ranges, and ones that are of use as a whole only."""
    import io
    import zipfile

    pad, out = bytes(3 * MB), io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.bin", pad)
    mov = FILES["zd.mov"]
    split = mov.rindex(b"mdat") - 4
    return {
        "k.pdf": FILES["k.pdf"].replace(b"trailer\n", b"%" + b" " * 30 * MB + b"\ntrailer\n", 1),
        "zb.mkv": FILES["zb.mkv"] + bytes(20 * MB),
        "zd.mov": mov[:split] + struct.pack(">I", 3 * MB + 8) + b"mdat" + pad,
        "g.heic": FILES["g.heic"] + box(b"free", pad),
        "a.zip": out.getvalue(),
        "x.bin": pad,
    }


def test_large_local_files_are_kept(spark, tmp_path):
    from filegrain.sources.files import read_files

    big = big_files()
    for name, b in (big | {"small.png": FILES["b.png"]}).items():
        (tmp_path / name).write_bytes(b)
    df = read_files(spark, str(tmp_path), full_limit=MB, max_full=2 * MB)
    rows = {r["name"]: r for r in df.collect()}
    assert set(rows) == {*big, "small.png"} and all(rows[n]["length"] == len(b) for n, b in big.items())
    assert {n for n, r in rows.items() if r["error"]} == {"a.zip", "x.bin"} and "too large" in rows["a.zip"]["error"]
    for name in ("k.pdf", "zb.mkv", "zd.mov", "g.heic"):
        parts = rows[name]["partial"]
        assert parts["total"] == len(big[name]) and sum(p["e"] - p["s"] for p in parts["parts"]) < len(big[name])
    reports = {r["info"]["name"]: r for r in extract(df.where("error IS NULL")).collect()}
    assert all(reports[n]["gps"] for n in ("k.pdf", "zd.mov", "g.heic")) and reports["zb.mkv"]["info"]["title"] == "A film"
    assert all(reports[n]["info"]["partial"] for n in ("k.pdf", "zb.mkv", "zd.mov", "g.heic")) and not reports["small.png"]["info"]["partial"]
    assert [r["name"] for r in read_files(spark, str(tmp_path), most=2, full_limit=MB, max_full=2 * MB).orderBy("name").collect()] == ["a.zip", "g.heic"]
    assert read_files(spark, str(tmp_path), full_limit=MB, max_full=64 * MB).where("error IS NOT NULL").count() == 0


def test_plan_alike_in_all_forms(spark):
    import random

    from filegrain.sources import plan

    kinds, sizes = ["pdf", "mkv", "jpeg", "zip", "ole", "mp4", "png", None], [1, 10 * MB, 64 * MB, 64 * MB + 1, 100 * MB, 900 * MB]
    df = spark.createDataFrame([(k, n) for k in kinds for n in sizes], "kind string, size long")
    for r in df.withColumn("parts", plan.planned("kind", "size")).collect():
        whole = r["kind"] in (None, "zip", "ole") or r["size"] <= plan.FULL_LIMIT
        want = [(0, r["size"])] if whole else None if r["kind"] == "mp4" else plan.end_parts(r["kind"], r["size"])
        assert want is None and r["parts"] is None or [tuple(p) for p in r["parts"]] == want
    rnd, rows = random.Random(3), []
    for _ in range(40):
        at, boxes = 0, []
        for _ in range(rnd.randint(1, 7)):
            n = rnd.choice([8, 16, 100, MB, 2 * MB, 65 * MB])
            boxes.append((rnd.choice(["ftyp", "moov", "mdat", "free", "abcd"]), at, at + n, 8))
            at += n
        rows.append((boxes, rnd.random() < 0.5, at))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "boxes array<struct<name:string,s:long,e:long,head:long>>, still boolean, size long")
    for r in df.withColumn("parts", plan.planned_boxes(F.col("boxes"), F.col("still"))).collect():
        boxes = [tuple(b) for b in r["boxes"]]
        assert plan.merged([tuple(p) for p in r["parts"]], r["size"]) == plan.merged(plan.box_parts(boxes, r["still"]), r["size"])
