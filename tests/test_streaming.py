"""Streams over several batches: keyed state that shrinks, expiry, and snapshots that a repeated batch doesn't change."""

import datetime
import time
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from filegrain.streaming import state
from filegrain.streaming.snapshots import Snapshots
from filegrain.streaming.tabs import is_media, progressive

EVENTS = "event_id long, tab_id long, url string, mime string, closed boolean, ts timestamp"


def at(minute):
    return datetime.datetime(2024, 1, 1, 12, minute)


BATCHES = [
    [(1, 1, "a", "image/png", False, at(1)), (2, 2, "b", "video/mp4", None, at(2)), (3, 3, "c", "text/html", False, at(3)), (4, None, "d", "image/png", False, at(3))],
    [(6, 1, "e", "application/pdf", False, at(5)), (5, 1, "x", "text/html", False, at(4)), (7, 2, None, None, True, at(6)), (8, 4, "f", "audio/ogg", False, at(7))],
    [(9, 4, "g", "text/html", False, at(8)), (10, 5, "h", "image/gif", False, None), (11, 5, "i", "text/html", False, at(9)), (12, 9, None, None, True, at(9))],
]


def test_tabs_that_close_leave_no_state(spark, tmp_path):
    seen, rows = [], []

    def start(stream, checkpoint):
        made = state.tab_changes(stream, is_media("mime"))
        each = lambda batch, number: rows.append((number, sorted(map(tuple, batch.collect()))))
        q = made.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        seen.append([p["stateOperators"][0]["customMetrics"].get("numRegisteredTimers", 0) for p in q.recentProgress if p["stateOperators"]])

    with state.keyed_state(spark):
        state.run_in_batches([spark.createDataFrame(b, EVENTS) for b in BATCHES], start)
    assert rows == [
        (0, [(1, "a", "image/png", False), (2, "b", "video/mp4", False)]),
        (1, [(1, "e", "application/pdf", False), (2, None, None, True), (4, "f", "audio/ogg", False)]),
        (2, [(4, None, None, True)]),
    ]


def test_tabs_now_over_batches(spark):
    changes = state.changes_of([spark.createDataFrame(b, EVENTS) for b in BATCHES], lambda s: state.tab_changes(s, is_media("mime")))
    assert sorted(map(tuple, state.tabs_now(changes).collect())) == [(1, "e", "application/pdf")]


def test_expiry_by_events_time_whatever_the_batches(spark):
    hour = datetime.timedelta(hours=1)
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    puts = [(1, 10, start), (1, 11, start + hour), (1, 12, start + 2.5 * hour), (2, 20, start), (3, 30, start + 2 * hour), (4, 40, start + 1.9 * hour), (None, 50, start), (5, 60, None), (6, 70, start + 3 * hour)]
    want = [(1, 11), (2, 20), (4, 40)]
    for cuts in ([9], [1, 4, 9], [3, 5, 6, 9]):
        ordered = sorted(puts, key=lambda p: p[2] or start)
        parts = [ordered[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        out = state.changes_of([spark.createDataFrame(p, "key long, item long, ts timestamp") for p in parts], lambda s: state.expired(s, hour, "ts"), "append")
        assert sorted((r["key"], r["item"]) for r in out.collect()) == want


class Held:
    """A key's state and timers in memory, with the calls that were made."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), []

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self.calls.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls.append("delete")
        self.timers.discard(at)

    def listTimers(self):  # noqa: N802
        self.calls.append("list")
        return list(self.timers)


def test_what_a_key_costs_does_not_grow_with_its_puts():
    """All that go out in a batch are one frame, and a batch of a key that is held takes two calls of the state."""
    held, machine = Held(), state._Expiring(10, True)
    machine.init(held)
    frames = lambda at: iter([pd.DataFrame({"at_ms": at[k : k + 7], "item": at[k : k + 7]}) for k in range(0, len(at), 7)])
    out = list(machine.handleInputRows((5,), frames([*range(0, 2000, 20), 1985, 1985]), None))
    assert [len(f) for f in out] == [99] and out[0]["item"].tolist() == list(range(0, 1980, 20)) and held.value == (1985, 1985)
    assert held.timers == {1996}
    held.calls.clear()
    out = list(machine.handleInputRows((5,), frames([1990, 1984, 2001, 2005]), None))
    assert [f["item"].tolist() for f in out] == [[1990]] and held.value == (2005, 2005) and len(held.calls) <= 2
    now = lambda at: SimpleNamespace(getCurrentWatermarkInMs=lambda: at, getExpiryTimeInMs=lambda: 1996)
    held.timers.clear()
    assert list(machine.handleExpiredTimer((5,), now(2015), now(2015))) == [] and held.timers == {2016}
    assert [f["item"].tolist() for f in machine.handleExpiredTimer((5,), now(2016), now(2016))] == [[2005]] and held.value is None


def test_expiry_by_the_clock(spark, tmp_path):
    """A key goes once the clock has moved past its time. Such a query has no end, so it is stopped."""
    got = []
    spark.createDataFrame([(1, 1), (2, 2)], "key long, item long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key long, item long").parquet(f"{tmp_path}/in")
    each = lambda batch, number: got.extend((r["key"], r["item"]) for r in batch.collect())
    with state.keyed_state(spark):
        made = state.expired(stream, datetime.timedelta(seconds=2))
        q = made.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
        for _ in range(60):
            if len(got) == 2 or not q.isActive:
                break
            time.sleep(0.5)
        q.stop()
    assert sorted(got) == [(1, 1), (2, 2)]


REPORTS = "item_seq long, flags array<struct<code:string,level:string,text:string>>, gps struct<lat:double,lon:double>, error string"


def reports(first, n):
    levels = [None, "info", "warn", "danger"]
    return [(k, [("c", levels[k % 4], "Contains author" if k % 3 else "JavaScript")] if k % 4 else None, (1.0, 2.0) if k % 5 == 0 else None, "lost" if k % 8 == 0 else None) for k in range(first, first + n)]


def test_progressive_shows_all_results_so_far(spark):
    shown = []
    parts = [spark.createDataFrame(reports(100 * k, 100), REPORTS) for k in range(3)]
    show = lambda rows, summary, n: shown.append((n, [r["item_seq"] for r in rows.collect()], tuple(summary.first())))
    state.run_in_batches(parts, lambda s, checkpoint: progressive(s, show, checkpoint, most=7).awaitTermination())
    severity = {1: 1, 2: 2, 3: 3}
    for n, best, sums in shown:
        rows = reports(0, 100 * (n + 1))
        order = sorted(rows, key=lambda r: (-severity.get(r[0] % 4, 0), r[0]))
        assert best == [r[0] for r in order[:7]]
        assert sums[:3] == (sum(r[1] is not None or r[3] is not None for r in rows), len(rows), sum(r[2] is not None for r in rows))
    assert [n for n, _, _ in shown] == [0, 1, 2]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    kept = Snapshots(spark, str(tmp_path / "s"), most=5)
    batches = [spark.createDataFrame(reports(20 * k, 20), REPORTS) for k in range(3)]
    for n in (0, 1, 1, 2, 2):
        kept.merge(batches[n], n)
    assert kept.summary(2).first()["total"] == 60
    assert [r["item_seq"] for r in kept.rows(2).collect()] == [3, 7, 11, 15, 19]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        kept.rows(0)  # only the last two stay


def test_snapshot_of_empty_batches(spark, tmp_path):
    kept = Snapshots(spark, str(tmp_path / "s"))
    empty = spark.createDataFrame([], REPORTS)
    kept.merge(empty, 0)
    kept.merge(spark.createDataFrame(reports(0, 4), REPORTS), 1)
    kept.merge(empty, 2)
    assert kept.summary(2).first()["total"] == 4 and kept.rows(2).count() == 4
    assert kept.rows(2).where(F.col("severity").isNull()).count() == 0
