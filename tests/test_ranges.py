"""Byte ranges as rows, intervals of hot keys, and sizes by a grid."""

import numpy as np
from pyspark.sql import functions as F

from filegrain.operators import relational as R
from filegrain.sources import ranges


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    data = np.random.default_rng(1).integers(0, 256, 5_000_003, dtype=np.uint8).tobytes()
    (tmp_path / "large.bin").write_bytes(data)
    (tmp_path / "small.bin").write_bytes(b"abc")
    (tmp_path / "empty.bin").write_bytes(b"")
    files = ranges.sizes(spark, str(tmp_path))
    cut = ranges.cut(files, 1 << 18)
    assert cut.count() == 21
    parts = ranges.read(cut, 6).withColumn("task", F.spark_partition_id())
    large = parts.where(F.col("path").endswith("large.bin")).groupBy("task").count().collect()
    assert len(large) >= 4 and max(r["count"] for r in large) < 12
    got = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in ranges.together(parts).collect()}
    assert got == {"large.bin": data, "small.bin": b"abc"}


def test_conditions_drop_ranges_before_they_are_read(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes(range(256)) * 40)
    files = spark.createDataFrame([(f"{tmp_path}/a.bin", 10_240), (f"{tmp_path}/gone.bin", 10_240)], "path string, size long")
    cut = ranges.cut(files, 1000)
    one = ranges.read(cut.where("path LIKE '%a.bin' AND s = 3000")).collect()
    assert [(r["s"], r["e"], bytes(r["bytes"]), r["error"]) for r in one] == [(3000, 4000, (bytes(range(256)) * 40)[3000:4000], None)]
    lost = ranges.together(ranges.read(cut)).collect()
    assert {r["path"].rsplit("/", 1)[1]: r["content"] is None for r in lost} == {"gone.bin": True, "a.bin": False}


def test_metadata_ranges(spark):
    mb = 1 << 20
    files = spark.createDataFrame([("p", 100 * mb, "pdf"), ("j", 3 * mb, "jpeg"), ("m", 100 * mb, "mp4")], "path string, size long, kind string")
    rows = ranges.metadata_ranges(files, range_bytes=8 * mb).collect()
    assert sorted((r["path"], r["s"] // mb, r["e"] // mb) for r in rows) == [("j", 0, 3), ("p", 0, 8), ("p", 84, 88), ("p", 88, 96), ("p", 96, 100)]


def test_intervals_of_a_hot_key(spark):
    r = np.random.default_rng(3)
    rows = [("hot", int(s), int(s + n)) for s, n in zip(r.integers(0, 200_000, 20_000), r.integers(0, 12, 20_000), strict=True)]
    rows += [("long", 5, 1_000_000), *(("long", k, k + 1) for k in range(0, 900_000, 300)), ("x", -5, 3), ("x", 3, 4), ("x", 9, 9), (None, 1, 2)]
    df = spark.createDataFrame(rows, "file string, s long, e long").repartition(5)
    want = sorted(map(tuple, R.merge_parts(df, "file").select("file", "s", "e").collect()), key=str)
    assert sorted(map(tuple, R.merge_spread(df, "file").collect()), key=str) == want
    assert (None, 1, 2) in want and len(want) > 1000
    tasks = df.where("e > s").repartitionByRange(8, "file", "s").groupBy(F.spark_partition_id().alias("t")).count().collect()
    assert max(t["count"] for t in tasks) < 0.4 * len(rows)  # the hot key is spread


def test_sizes_by_a_grid(spark):
    sizes = spark.createDataFrame([(0, "A4", 595, 842), (1, "near A4", 597, 842), (2, "square", 100, 100)], "ordinal int, name string, w int, h int")
    df = spark.createDataFrame([(1, 598, 842), (2, 842, 595), (3, 599, 842), (4, 103, 97), (5, 104, 100), (6, None, 100), (7, -1, 3)], "id int, w int, h int")
    out = R.nearest_size(df, "w", "h", sizes)
    assert sorted((r["id"], r["paper"]) for r in out.collect()) == [(1, "A4"), (2, "A4"), (3, "near A4"), (4, "square"), (5, None), (6, None), (7, None)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
