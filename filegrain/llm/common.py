"""What the operators of this subpackage share: reading columns, sizing parts, and packed integers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import removed, scratch, shared_dir  # noqa: F401

#: White space that ends a word. bytes.split() without arguments splits at exactly these.
SPACE = r"[\x20\x09-\x0D]+"
#: Stands for a null id where ids are compared: a null id is never the smaller one.
NULL_ID = np.iinfo(np.int64).max


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def place(df: DataFrame, name: str) -> int:
    """Where df's column of that name is: the first that is spelled so, else the only one that differs in case alone."""
    if name in df.columns:
        return df.columns.index(name)
    alike = [k for k, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(alike) != 1:
        raise ValueError(f"{len(alike)} columns are named {name}: {df.columns}")
    return alike[0]


def numbered(df: DataFrame) -> DataFrame:
    """df's columns as c0, c1, ...: names that differ in case alone, repeat, or are an operator's own can't clash then."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def at(df: DataFrame, name: str) -> str:
    """The name that a column of df has in numbered(df)."""
    return f"c{place(df, name)}"


def named(df: DataFrame, out: DataFrame, *more) -> DataFrame:
    """df's columns of out, which has them as numbered(df) does, under their names again; and more."""
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(df.columns)], *more)


def own_prefix(df: DataFrame) -> str:
    """fg_, with so many more underscores that no column of df begins so: for what an operator adds to df's rows."""
    prefix = "fg_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def pick(df: DataFrame, **columns: tuple[str, str]) -> DataFrame:
    """Only the given columns, as own=(name in df, type): what else df holds can't clash."""
    return numbered(df).select(*[F.col(at(df, name)).cast(kind).alias(own) for own, (name, kind) in columns.items()])


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of UTF-8 in a column; one scan of that column."""
    return int(df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0)


#: Partitions that a table is dealt into at most, unless the session asks for more: what is kept of each stays small.
MOST_PARTS = 100_000


def parts_for(df: DataFrame, text: str, part_bytes: int) -> int:
    """How many parts of about part_bytes (more, beyond MOST_PARTS) hold the column's text, never fewer than the shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(MOST_PARTS, math.ceil(text_bytes(df, text) / part_bytes)))


def words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder of spark.checkpoint.dir, which every executor reaches.

    Only where the session has no such setting, as in tests, an own folder is set. With
    spark.cleaner.referenceTracking.cleanCheckpoints Spark removes the files once nothing refers to them.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def pack(values: np.ndarray, width: int) -> bytes:
    """Unsigned integers in width bits each, lowest bit first, without gaps."""
    if width in (8, 16, 32, 64):
        return np.ascontiguousarray(values, dtype=f"<u{width // 8}").tobytes()
    if not width or not len(values):
        return b""
    raw = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, : (width + 7) // 8]
    bits = np.unpackbits(np.ascontiguousarray(raw), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int, first: int = 0) -> np.ndarray:
    """n integers of pack() from the one numbered first; only their bytes are touched."""
    if not width or not n:
        return np.zeros(n, np.uint64)
    at = first * width
    if width in (8, 16, 32, 64):
        return np.frombuffer(data, f"<u{width // 8}", n, at // 8).astype(np.uint64)
    raw = np.frombuffer(data, np.uint8)[at // 8 : (at + n * width + 7) // 8]
    bits = np.unpackbits(raw, bitorder="little")[at % 8 : at % 8 + n * width].reshape(n, width)
    full = np.zeros((n, 64), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u8").ravel()


def golomb(values: np.ndarray) -> bytes:
    """Sorted distinct uint64 values as Golomb-Rice coded gaps.

    Quotients (unary) and remainders (fixed width) are two streams, so either is read without a loop.
    """
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values, prepend=np.uint64(0))
    width = max(0, int(int(values[-1]) / n).bit_length() - 1)
    quotients = (gaps >> np.uint64(width)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + n, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    head = np.array([n, width, len(unary)], "<u4").tobytes()
    return head + np.packbits(unary, bitorder="little").tobytes() + pack(gaps & np.uint64((1 << width) - 1), width)


def ungolomb(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    n, width, size = np.frombuffer(data, "<u4", 3).tolist()
    end = 12 + (size + 7) // 8
    unary = np.unpackbits(np.frombuffer(data, np.uint8)[12:end], count=size, bitorder="little")
    quotients = np.diff(np.flatnonzero(unary), prepend=-1) - 1
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(width)) | unpack(data[end:], width, n))


def bucket_cuts(values: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where sorted values of so many bits cross from one owner's range into the next: buckets + 1 places."""
    bounds = np.array([((1 << bits) * b) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(values, bounds), [len(values)]]).astype(np.int64)


def pieces(columns: dict, text: str = "text", most: int = 4 << 20):
    """Slices [a, b) of a batch's rows with about so many characters of text each."""
    sizes = np.array([len(t) if t else 0 for t in columns[text]], np.int64)
    a, total = 0, 0
    for b, size in enumerate(sizes):
        total += int(size)
        if total >= most:
            yield a, b + 1
            a, total = b + 1, 0
    if a < len(sizes):
        yield a, len(sizes)


class Generations(dict):
    """A bounded cache: of what it held when it was last full, it keeps what has been asked for since."""

    def __init__(self, most: int, make=None):
        super().__init__()
        self.most, self.make, self.old = most, make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
