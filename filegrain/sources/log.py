"""A log of events in numbered epochs, and a streaming source over it with offsets and replay.

append() writes an epoch: a folder of text files, one event a line, that counts once it is complete. The source's offset is
the number of the last complete epoch, so it takes constant space, and the same two offsets always give the same lines:
each has an identity (epoch, file, at), by which a sink can leave out what it has already.
"""

from __future__ import annotations

import io
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .saved import _at

SCHEMA = "epoch long, file string, at long, line string"
DONE = "_SUCCESS"
#: A task reads at most this much of a file.
RANGE_BYTES = 32 << 20
LINES = 4096


def _numbers(log: str) -> list[int]:
    from pyarrow.fs import FileSelector

    files, base = _at(log)
    return sorted(int(i.base_name) for i in files.get_file_info(FileSelector(base, allow_not_found=True)) if re.fullmatch(r"\d{12}", i.base_name))


def _epochs(log: str, after: int = 0) -> int:
    """The last epoch up to which all that haven't been dropped are complete."""
    from pyarrow.fs import FileType

    files, base = _at(log)
    n = after
    for k in _numbers(log):
        if k > n:
            if files.get_file_info(f"{base}/{k:012d}/{DONE}").type != FileType.File:
                break
            n = k
    return n


def append(events: DataFrame, log: str) -> int:
    """Write events (one column of strings without line breaks, or any columns, which become JSON) as the next epoch; its number.

    One writer at a time. An epoch that was left incomplete is written anew.
    """
    log = log.rstrip("/")
    number = _epochs(log) + 1
    lines = events if events.columns == ["line"] else events.select(F.to_json(F.struct(*events.columns)).alias("line"))
    lines.write.mode("overwrite").text(f"{log}/{number:012d}")
    return number


@dataclass
class Piece(InputPartition):
    epoch: int
    path: str
    start: int
    end: int


class LogReader(DataSourceStreamReader):
    def __init__(self, options):
        self.log = options["path"].rstrip("/")
        self.first = int(options.get("after", "0"))
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.known = self.first

    def initialOffset(self) -> dict:  # noqa: N802
        return {"epoch": self.first}

    def latestOffset(self) -> dict:  # noqa: N802
        self.known = _epochs(self.log, self.known)
        return {"epoch": self.known}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        from pyarrow.fs import FileSelector

        files, base = _at(self.log)
        out = []
        for epoch in range(start["epoch"] + 1, end["epoch"] + 1):
            found = files.get_file_info(FileSelector(f"{base}/{epoch:012d}"))
            for i in sorted(found, key=lambda i: i.path):
                if i.size and not i.base_name.startswith(("_", ".")):
                    out += [Piece(epoch, i.base_name, s, min(i.size, s + self.range_bytes)) for s in range(0, i.size, self.range_bytes)]
        self.known = max(self.known, end["epoch"])
        return out

    def read(self, partition: Piece):
        """Lines that begin within the piece; the last one is read to its end."""
        files, base = _at(self.log)
        with io.BufferedReader(files.open_input_file(f"{base}/{partition.epoch:012d}/{partition.path}"), 1 << 20) as file:
            at = partition.start
            if at:  # a line that begins before belongs to the piece before
                file.seek(at - 1)
                at += len(file.readline()) - 1
            rows = []
            while at < partition.end and (line := file.readline()):
                rows.append((at, line.removesuffix(b"\n").decode()))
                at += len(line)
                if len(rows) == LINES:
                    yield self._batch(partition, rows)
                    rows = []
            if rows:
                yield self._batch(partition, rows)

    def _batch(self, p: Piece, rows: list) -> pa.RecordBatch:
        n = len(rows)
        return pa.record_batch([pa.array([p.epoch] * n, pa.int64()), pa.array([p.path] * n), pa.array([a for a, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.string())], ["epoch", "file", "at", "line"])

    def commit(self, end: dict) -> None:
        pass  # epochs stay: other queries may read them; drop() removes them

    def stop(self) -> None:
        pass


class EventLog(DataSource):
    """Streams a log's lines: spark.readStream.format("event_log").load(path). Options: after (an epoch to start behind), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogReader:  # noqa: N802
        return LogReader(self.options)


def stream(spark: SparkSession, log: str, **options) -> DataFrame:
    """epoch, file, at, line of a log's events as they are appended."""
    spark.dataSource.register(EventLog)
    return spark.readStream.format("event_log").options(**options).load(log)


def drop(log: str, until: int) -> int:
    """Remove epochs up to a number that all queries have behind them, but never the last complete one, after which numbers go on; how many."""
    files, base = _at(log.rstrip("/"))
    old = [k for k in _numbers(log) if k <= until and k < _epochs(log)]
    for k in old:
        files.delete_dir(f"{base}/{k:012d}")
    return len(old)
