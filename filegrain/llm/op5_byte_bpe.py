"""Byte-level BPE encoding and decoding with a vectorised pre-tokenisation.

Texts of a batch become one array of code points, and each code point a class (letter, number, other, white space
by its place in a run, apostrophe by the contraction it opens). Each class is a function on the eight states of the
pattern's automaton. These functions and their compositions form a small monoid, so composing them is a look-up in
its multiplication table, which is associative: the state before every code point comes from a scan over rows of
the array at once, then over the rows' totals. A table of (state, class) then says where a slice starts. No regular
expression runs. Slices feed a cache of merged pairs, whose misses are merged by the tokenizer library; with
offsets=True the byte offset of each token is retained, so a range of text is decoded from its tokens alone.

Defined results: null text is empty, and has no tokens. Any ids of the vocabulary decode to bytes, which need not
be valid UTF-8 before they are joined. Null ids stay null; rows that repeat an id or a text are rows each. Very long
texts are encoded whole, in a batch of their own. An empty table gives an empty one. Other columns of docs, whatever
their names, are not read.
"""

from __future__ import annotations

import base64
import struct
import unicodedata
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Generations, pick, pieces, table

#: Distinct slices in each of the two generations of a worker's cache.
CACHED = 150_000
#: Unicode's White_Space. Fixed values.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, OTHER, OPEN2, OPEN3, LAST_BLANK, LAST_SPACE, SPACE = range(8)
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, IN_SPACE, ONE_LEFT, TWO_LEFT = range(8)
ROW = 64


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The state after a code point of this class, and whether a slice starts at it."""
    if kind == LETTER and state == TWO_LEFT:
        return ONE_LEFT, False
    if kind == LETTER and state == ONE_LEFT:
        return START, False
    if kind in (OPEN2, OPEN3):
        if state not in (IN_OTHERS, AFTER_BLANK):
            return (ONE_LEFT if kind == OPEN2 else TWO_LEFT), True
        kind = OTHER
    if kind <= OTHER:
        own = (IN_LETTERS, IN_NUMBERS, IN_OTHERS)[kind]
        return own, state not in (own, AFTER_BLANK)
    if kind == SPACE:
        return IN_SPACE, state != IN_SPACE
    return (AFTER_BLANK if kind == LAST_BLANK else START), True


@cache
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Monoid element of each class (8 more: at the start of a text); product of elements, flat; state by element and state, flat; starts by state and class, flat."""
    steps = [tuple(_step(s, k)[0] for s in range(8)) for k in range(8)]
    steps += [(_step(START, k)[0],) * 8 for k in range(8)]
    elements = [tuple(range(8)), *dict.fromkeys(steps)]
    at = {e: i for i, e in enumerate(elements)}
    for e in elements:  # grows meanwhile
        for f in steps:
            product = tuple(f[x] for x in e)
            if product not in at:
                at[product] = len(elements)
                elements.append(product)
    n = len(elements)
    assert n <= 256
    product = np.array([[at[tuple(f[x] for x in e)] for f in elements] for e in elements], np.uint8)
    starts = np.array([[_step(s, k)[1] for k in range(8)] + [True] * 8 for s in range(8)])
    return np.array([at[s] for s in steps], np.uint8), product.ravel(), np.array(elements, np.uint8).ravel(), starts.ravel()


@cache
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE for each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[WHITE_SPACE] = SPACE
    return out


def _states(elements: np.ndarray) -> np.ndarray:
    """The state before each place, from monoid elements; START before the first."""
    _, product, apply, _ = _automaton()
    n = len(elements)
    size = int(round(len(product) ** 0.5))
    if n <= ROW:
        out, state = np.empty(n, np.uint8), START
        for i, e in enumerate(elements.tolist()):
            out[i] = state
            state = int(apply[e * 8 + state])
        return out
    rows = -(-n // ROW)
    grid = np.zeros((ROW, rows), np.uint8)  # 0: the identity
    padded = np.zeros(rows * ROW, np.uint8)
    padded[:n] = elements
    grid[:] = padded.reshape(rows, ROW).T
    for j in range(1, ROW):
        grid[j] = product[grid[j - 1].astype(np.int32) * size + grid[j]]
    first = _states(grid[-1].copy())
    out = np.empty((ROW, rows), np.uint8)
    out[0] = first
    for j in range(1, ROW):
        out[j] = apply[grid[j - 1].astype(np.int32) * 8 + first]
    return out.T.ravel()[:n]


def slices(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """UTF-8 of all texts; byte offsets at which slices start, and the end; where each text's slices begin among them."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    lengths = np.array([len(t) for t in texts], np.int64)
    if not n:
        return b"", np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    kinds = _classes()[points]
    begins = np.cumsum(lengths)[:-1]
    first = np.zeros(n + 1, bool)
    first[0] = True
    first[begins] = True  # of an empty last text: the place after the end
    last = first[1:].copy()
    last[-1] = True
    space = kinds == SPACE
    ends = space[:-1] & ~space[1:] & ~last[:-1]  # white space before something else in the same text
    ends = np.flatnonzero(ends)
    kinds[ends] = np.where(points[ends] == 32, LAST_BLANK, LAST_SPACE)
    at = np.flatnonzero(points == 39)
    at = at[~last[at]] if len(at) else at
    if len(at):
        nxt = points[at + 1]
        kinds[at[np.isin(nxt, [ord(c) for c in "stmd"])]] = OPEN2
        far = at + 2 < n
        at, nxt = at[far], nxt[far]
        more = points[at + 2]
        three = ((nxt == ord("r")) & (more == ord("e"))) | ((nxt == ord("v")) & (more == ord("e"))) | ((nxt == ord("l")) & (more == ord("l")))
        kinds[at[three & ~last[at + 1]]] = OPEN3
    symbols = kinds + np.uint8(8) * first[:n]
    of, _, _, starts = _automaton()
    start = starts[_states(of[symbols]).astype(np.int32) * 16 + symbols]
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    offset = np.concatenate([[0], np.cumsum(width)])
    at = np.flatnonzero(start)
    bounds = np.searchsorted(at, np.concatenate([[0], np.cumsum(lengths)]))
    return joined.encode("utf-8", "surrogatepass"), np.append(offset[at], offset[-1]), bounds


class Codec:
    """Merges and decodes by the ranks in a file of the tiktoken library."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        merge = tiktoken.Encoding("ranks", pat_str=r"\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        alone = {token: struct.pack("<i", rank) for token, rank in ranks.items()}
        self.merged = Generations(CACHED, lambda piece: alone.get(piece) or array("i", merge(piece)).tobytes())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin among them (one more: the end)."""
        data, starts, bounds = slices(texts)
        at = starts.tolist()
        self.merged.trim()
        get, bounds = self.merged.__getitem__, bounds.tolist()
        found = [data[a:b] for a, b in zip(at, at[1:])]  # noqa: B905
        out = [b"".join(map(get, found[a:b])) for a, b in zip(bounds, bounds[1:])]  # noqa: B905
        return np.frombuffer(b"".join(out), "<i4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in out], dtype=np.int64)])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    @property
    def lengths(self) -> np.ndarray:
        return np.array([len(t) for t in self.bytes_of], np.int32)


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, offsets: bool = False, decoded: bool = False) -> DataFrame:
    """doc_id, ids; with offsets=True also offsets: the byte at which each token starts in the text's UTF-8; with decoded=True also the bytes that the ids decode to."""
    path = ranks or default_ranks()

    def run(batches):
        own = codec(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in pieces({"text": texts}, most=1 << 20):
                ids, bounds = own.encode(texts[a:b])
                out = {"doc_id": batch.column("doc_id").slice(a, b - a), "ids": _lists(ids, bounds)}
                if offsets:
                    ends = np.cumsum(own.lengths[ids], dtype=np.int64)
                    begins = np.concatenate([[0], ends])[:-1] if len(ids) else ends
                    size = np.diff(bounds)
                    base = np.concatenate([[0], ends])[bounds[:-1]]
                    out["offsets"] = _lists((begins - np.repeat(base, size)).astype(np.int32), bounds)
                if decoded:
                    out["decoded"] = _decoded(own, ids, bounds)
                yield pa.record_batch(out)

    rows = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>" + ", offsets array<int>" * offsets + ", decoded binary" * decoded)


def _decoded(own: Codec, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.array([own.decode(ids[a:b].tolist()) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)], pa.binary())


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, ids, decoded (bytes) of encode()'s rows."""
    path = ranks or default_ranks()

    def run(batches):
        own = codec(path)
        for batch in batches:
            column = batch.column("ids")
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "ids": column, "decoded": _decoded(own, column.values.to_numpy(), column.offsets.to_numpy())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents"), decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
