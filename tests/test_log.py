"""The log of events: epochs, offsets, pieces, and restarts that neither lose nor repeat."""

import os

from pyspark.sql import functions as F

from filegrain.sources import log


def run(spark, at, out, **options):
    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    log.stream(spark, at, **options).writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(log.SCHEMA).parquet(out) if os.path.exists(out) else None


def test_pieces_hold_each_line_once(spark, tmp_path):
    lines = ["", "a", "ü" * 30, "x" * 500, *(str(k) * (k % 7) for k in range(200)), "end"]
    at = str(tmp_path / "log")
    log.append(spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1), at)
    for size in (1, 7, 64, 1 << 20):
        reader = log.LogReader({"path": at, "rangebytes": str(size)})
        pieces = reader.partitions(reader.initialOffset(), reader.latestOffset())
        got = [(r["at"], r["line"]) for p in pieces for b in reader.read(p) for r in b.to_pylist()]
        assert [x for _, x in got] == lines and len({a for a, _ in got}) == len(lines)
        assert len(pieces) == -(-sum(len(x.encode()) + 1 for x in lines) // size)


def test_restarts_neither_lose_nor_repeat(spark, tmp_path):
    at, out = str(tmp_path / "log"), str(tmp_path / "out")
    for k in range(3):
        assert log.append(spark.range(100 * k, 100 * k + 100), at) == k + 1
        got = run(spark, at, out, rangeBytes="100")
    assert run(spark, at, out).count() == 300
    assert sorted(r[0] for r in got.select(F.get_json_object("line", "$.id").cast("int")).collect()) == list(range(300))


def test_an_epoch_counts_once_it_is_complete(spark, tmp_path):
    at, out = str(tmp_path / "log"), str(tmp_path / "out")
    log.append(spark.range(5), at)
    os.makedirs(f"{at}/000000000002")
    with open(f"{at}/000000000002/part-0.txt", "w") as f:
        f.write('{"id":77}\n')
    assert run(spark, at, out).count() == 5
    assert log.append(spark.range(5, 8), at) == 2
    assert sorted(r["line"] for r in run(spark, at, out).collect()) == [f'{{"id":{k}}}' for k in range(8)]


def test_a_batch_that_failed_is_read_again_the_same(spark, tmp_path):
    at, seen, fails = str(tmp_path / "log"), [], [True]
    log.append(spark.range(50), at)

    def show(batch, number):
        seen.append((number, sorted(map(tuple, batch.collect()))))
        if fails.pop() if fails else False:
            raise RuntimeError("lost")

    for k in range(3):
        if k == 1:
            log.append(spark.range(50, 60), at)  # what is new belongs to the next batch
        q = log.stream(spark, at).writeStream.foreachBatch(show).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception as e:
            assert "lost" in str(e)
    assert [n for n, _ in seen] == [0, 0, 1] and seen[0] == seen[1] and len(seen[0][1]) == 50 and len(seen[2][1]) == 10


def test_epochs_that_are_done_go(spark, tmp_path):
    at, out = str(tmp_path / "log"), str(tmp_path / "out")
    for k in range(3):
        log.append(spark.range(k, k + 1), at)
    assert run(spark, at, out).count() == 3
    assert log.drop(at, 9) == 2 and sorted(os.listdir(at)) == ["000000000003"]
    assert log.append(spark.range(3, 4), at) == 4
    assert sorted(r["line"] for r in run(spark, at, out).collect()) == [f'{{"id":{k}}}' for k in range(4)]
