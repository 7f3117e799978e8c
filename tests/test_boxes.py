"""Boxes by expressions give what the walk over a file gives."""

import random
import struct

from pyspark.sql import functions as F

from filegrain.sources import boxes, partial


class Held:
    def __init__(self, data):
        self.data = data

    def read(self, s, e):
        return self.data[s:e]


def made(r):
    out = b""
    for _ in range(r.randrange(6)):
        n, kind = r.randrange(40), bytes(r.choice(b"abcxyz\xa9\xff") for _ in range(4))
        form = r.randrange(8)
        out += {0: struct.pack(">I4sQ", 1, kind, 16 + n), 1: struct.pack(">I4s", r.choice((0, 2, 7, 9, 1 << 31)), kind), 2: struct.pack(">I4sQ", 1, kind, r.choice((3, 15, 1 << 63, (1 << 64) - 1)))}.get(form, struct.pack(">I4s", 8 + n, kind)) + bytes(n)
    return out + bytes(r.randrange(10))


def test_boxes_against_the_walk(spark):
    r, rows = random.Random(4), []
    files = [made(r) for _ in range(300)] + [b"", b"1234567", struct.pack(">I4s", 8, b"free") * 2100]
    for k, data in enumerate(files):
        cuts = sorted({0, len(data), *(r.randrange(len(data) + 1) for _ in range(3))})
        rows.append((k, len(data), [(s, data[s:e]) for s, e in zip(cuts, cuts[1:], strict=False)]))
    df = spark.createDataFrame(rows, "id int, size long, pieces array<struct<s:bigint,bytes:binary>>")
    out = df.select("id", boxes.top_boxes(F.col("pieces"), F.col("size")).alias("x"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for row in out.collect():
        data = files[row["id"]]
        assert [tuple(b) for b in row["x"]["boxes"]] == partial.top_boxes(Held(data), len(data)), data
        assert row["x"]["next"] is None


def test_a_walk_goes_on_where_bytes_are_missing(spark):
    data = struct.pack(">I4s", 100, b"ftyp") + bytes(92) + struct.pack(">I4sQ", 1, b"mdat", 1 << 40) + struct.pack(">I4s", 50, b"moov")
    size = 100 + (1 << 40) + 50
    rows = [(1, size, [(0, data[:40])]), (2, size, [(0, data[:40]), (100, data[100:110])]), (3, size, [(0, data[:40]), (100, data[100:116])]), (4, size, [(0, data[:40]), (100, data[100:116]), (100 + (1 << 40), data[116:])]), (5, None, None), (6, 100, None)]
    df = spark.createDataFrame(rows, "id int, size long, pieces array<struct<s:bigint,bytes:binary>>")
    got = {r["id"]: r["x"] for r in df.select("id", boxes.top_boxes(F.col("pieces"), F.col("size")).alias("x")).collect()}
    assert [got[k]["next"] for k in range(1, 7)] == [100, 100, 100 + (1 << 40), None, None, 0]
    assert [[b["type"] for b in got[k]["boxes"]] for k in range(1, 7)] == [["ftyp"], ["ftyp"], ["ftyp", "mdat"], ["ftyp", "mdat", "moov"], [], []]
