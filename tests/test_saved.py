"""Rows as files of their own, and one exact file."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from filegrain import catalog
from filegrain.operators.layout import apart, placed
from filegrain.sources import saved


def test_running_sums_over_all_tasks(spark):
    r = np.random.default_rng(2)
    rows = [(int(k), int(n) if n else None) for k, n in zip(r.permutation(5000), r.integers(0, 9, 5000), strict=True)]
    out = placed(spark.createDataFrame(rows, "k int, n int").repartition(7), ["k"], F.col("n"))
    got = {x["k"]: x["fg_at"] for x in out.collect()}
    want, at = {}, 0
    for k, n in sorted(rows):
        want[k], at = at, at + (n or 0)
    assert got == want and out.columns == ["k", "n", "fg_at"]
    assert placed(spark.createDataFrame([], "k int"), ["k"], F.lit(1)).count() == 0


def test_names_apart(spark):
    names = ["a.pdf"] * 4 + ["a (2).pdf", "a (7).pdf", "b", "b", "", None, "..", "x/y.z", "x_y.z", "a (2).pdf"]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = {r["id"]: r["fg_name"] for r in apart(rows, "name", ["id"]).collect()}
    assert len(set(got.values())) == len(names)
    assert got[0] == "a.pdf" and got[4] == "a (2).pdf" and got[5] == "a (7).pdf" and got[6] == "b" and got[7] == "b (2)"
    assert [got[k] for k in (8, 9, 10)] == ["file", "file (2)", "file (3)"]
    assert sorted(got[k] for k in (11, 12)) == ["x_y (2).z", "x_y.z"]
    assert all(int(got[k].split("(")[1].split(")")[0]) > 7 for k in (1, 2, 3, 13))


def test_a_hot_name_is_spread(spark):
    rows = spark.range(4000).select("id", F.lit("image-clean.jpg").alias("name"))
    got = sorted(r["fg_name"] for r in apart(rows, "name", ["id"]).collect())
    assert got == sorted(["image-clean.jpg", *(f"image-clean ({k}).jpg" for k in range(2, 4001))])


def test_one_file_a_row(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a.txt", b"one"), (2, "a.txt", b""), (3, "b.bin", b"\x00\xff"), (4, "gone", None)], "id int, name string, bytes binary")
    path = str(tmp_path / "out")
    told = saved.write_files(rows, path, order=["id"])
    assert {(r["id"], r["fg_name"]) for r in told.collect()} == {(1, "a.txt"), (2, "a (2).txt"), (3, "b.bin")}
    assert {f: open(f"{path}/{f}", "rb").read() for f in os.listdir(path)} == {"a.txt": b"one", "a (2).txt": b"", "b.bin": b"\x00\xff"}
    assert os.listdir(tmp_path) == ["out"]


def test_files_are_read_by_their_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(saved, "BUFFER", 5)
    names = ["a b.txt", "a+b%20.txt", "ü#?.bin", "plain", "plain"]
    rows = spark.createDataFrame([(k, n, b"x" * k) for k, n in enumerate(names)], "id int, name string, bytes binary")
    told = saved.write_files(rows, str(tmp_path / "out"), order=["id"])
    got = {r["name"]: bytes(r["content"]) for r in saved.read_files(told, str(tmp_path / "out")).collect()}
    assert got == {"a b.txt": b"", "a+b%20.txt": b"x", "ü#?.bin": b"xx", "plain": b"xxx", "plain (2)": b"xxxx"}
    os.remove(tmp_path / "out" / "plain")
    with pytest.raises(Exception, match="plain"):
        saved.read_files(told, str(tmp_path / "out")).collect()


def test_the_driver_lists_no_saved_file(spark):
    out = catalog.queries()["k06_saved_files"](spark, "/root/testdata/sf0.001")
    assert out.count() == 200 and not [f for f in out.inputFiles() if not f.endswith(".parquet")]


def test_a_run_that_fails_leaves_no_file(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") == 31, F.raise_error(F.lit("killed"))).otherwise(F.lit("x")).cast("binary").alias("bytes"))
    spark.dataSource.register(saved.FilesSink)
    stage = f"{tmp_path}/out.staged/run"
    with pytest.raises(Exception, match="killed"):
        rows.write.format("one_file_a_row").option("stage", stage).mode("append").save()
    assert not os.path.exists(stage)
    assert saved.finish(spark, f"{tmp_path}/out") == 0 and os.listdir(f"{tmp_path}/out") == []


def test_a_run_that_stops_after_its_commit_is_completed(spark, tmp_path):
    spark.dataSource.register(saved.FilesSink)
    path = f"{tmp_path}/out"
    rows = spark.range(9).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.lit("x").cast("binary").alias("bytes"))
    rows.write.format("one_file_a_row").option("stage", f"{path}.staged/run").mode("append").save()
    os.makedirs(f"{path}.staged/run/left-by-a-killed-task")
    open(f"{path}.staged/run/left-by-a-killed-task/f99", "w").close()
    assert not os.path.exists(path)
    assert saved.finish(spark, path) == 9 and sorted(os.listdir(path)) == [f"f{k}" for k in range(9)]
    assert saved.finish(spark, path) == 0 and not os.path.exists(f"{path}.staged")


def test_one_exact_file(spark, tmp_path):
    lines = [(k, None if k == 7 else "ü" * (k % 13) + str(k)) for k in range(3000)] + [(3000, "z" * 20_000_000), (3001, "end")]
    df = spark.createDataFrame(lines, "seq int, line string").repartition(6)
    path = str(tmp_path / "out.csv")
    n = saved.write_exact(df, path, ["seq"])
    want = "\r\n".join(x or "" for _, x in lines).encode()
    assert open(path, "rb").read() == want and n == len(want) and os.listdir(tmp_path) == ["out.csv"]
    assert saved.write_exact(df.limit(0), path, ["seq"]) == 0 and os.path.getsize(path) == 0
    with pytest.raises(ValueError):
        saved.write_exact(df, "s3://bucket/x", ["seq"])
