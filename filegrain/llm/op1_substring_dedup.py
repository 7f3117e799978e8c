"""Substring dedup with difference-cover anchors.

A match of 13 words at place p of one text and q of another has an offset k < 7 for which p + k and q + k
both lie, modulo 7, in the difference cover {0, 1, 3}. So it is enough to hash the 7-word windows at cover
places (3 of 7 places): any match of 13 words holds one such anchor at the same offset on either side.
Only windows around an anchor that another document has as well are extended: hashed whole, and compared by 96 bits,
under which 10^12 distinct windows meet by chance once in 10^5 corpora.

Work goes by parts (documents by a hash of id and text, so that no id gathers in one) of part_bytes. A part sends its
sorted distinct hashes, Golomb coded, to the hashes' owners, and gets a bit for each back. A hash comes from a part once
at most, however often the part's texts hold it, so a passage in a third of all documents costs its owner a few bytes
for each part and no more. No pairs are made.

With as many owners as parts, parts * parts blobs would go either way. So they go through relays: a relay takes what
some root of parts parts send to the root of owners owners, merges it, and passes a blob to each of these; answers come
back the same way. That is 2 * parts^1.5 blobs, some 10^9 for 100 TB in parts of LEAST_PART * 20. There are as many
tasks as parts at each step, so a task's size doesn't grow with the input.

Defined results: a null text has no words. A null id is larger than any other, so its text never makes
another document lose words. Rows that repeat an id count as one document: neither loses words to the other. Very long
texts are read whole, within one part. An empty table gives an empty one. Other columns of docs, whatever their names,
are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, bucket_cuts, golomb, pick, table, text_bytes, ungolomb, words

ANCHOR_BITS = 48
#: Bytes of text in a part: at least these, and beyond MOST_PARTS of them so many more. A part takes some ten times that in memory.
LEAST_PART, MOST_PARTS = 10 << 20, 500_000
#: The period of the cover and the places in it; every difference modulo the period occurs among the places.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
MULTIPLIERS = np.random.default_rng(13).integers(0, 2**63, (2, 4096), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: What a sender (part or relay) has for a receiver (relay or owner), and what it gets back.
BLOB = "sender long, receiver long, n long, blob binary, more binary"
REPLY = "sender long, kind int, receiver long, n long, bits binary"


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover and anchor length for matches of window words: anchor + period - 1 = window."""
    period = max((p for p in COVERS if 2 * p <= window + 1), default=1)
    return period, COVERS.get(period, (0,)), window - period + 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _hashes(at: np.ndarray, hashed: np.ndarray, length: int, row: int) -> np.ndarray:
    """Hashes of the windows of so many words that start at the given places."""
    out = np.zeros(len(at), np.uint64)
    for k in range(length):
        out += hashed[at + k] * MULTIPLIERS[row, k]
    return _mix(out)


class _Part:
    """The documents of a part in ascending order of their ids, and the hashes of their words."""

    def __init__(self, rows: pa.Table, window: int):
        ids = rows.column("doc_id").to_pylist()
        texts = rows.column("text").to_pylist()
        self.order = sorted(range(len(ids)), key=lambda i: (NULL_ID if ids[i] is None else ids[i], texts[i] or ""))
        self.window = window
        self.ids = [ids[i] for i in self.order]
        self.texts = [texts[i] for i in self.order]
        self.keys = np.array([NULL_ID if i is None else i for i in self.ids], np.int64)
        each = [np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w)) for w in map(words, self.texts)]
        self.n_words = np.array([len(x) for x in each], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.n_words)])
        self.hashed = np.concatenate([*each, np.zeros(0, np.uint64)])
        self.doc = np.repeat(np.arange(len(each), dtype=np.int32), self.n_words)
        self.place = (np.arange(len(self.hashed)) - self.starts[self.doc]).astype(np.int32)
        self.left = self.n_words.astype(np.int32)[self.doc] - self.place

    def anchors(self) -> None:
        """at: where anchors start; unique: their sorted distinct hashes; index: of each anchor, in unique; own: is it in two documents of this part."""
        period, cover, length = cover_for(self.window)
        long = (self.left >= length) & (self.n_words[self.doc] >= self.window)
        self.at = np.flatnonzero(long & np.isin(self.place % period, cover))
        values = _hashes(self.at, self.hashed, length, 0) >> np.uint64(64 - ANCHOR_BITS)
        self.unique, first, self.index = np.unique(values, return_index=True, return_inverse=True)
        doc = self.doc[self.at]
        self.own = np.zeros(len(self.unique), bool)
        self.own[self.index[doc != doc[first][self.index]]] = True

    def candidates(self, shared: np.ndarray) -> None:
        """where: starts of windows that hold an anchor which another document has; first, second: their hashes; those distinct, with the smallest id here."""
        period, _, _ = cover_for(self.window)
        flags = np.zeros(len(self.hashed) + period + 1, np.int64)
        flags[self.at[shared[self.index]] + 1] = 1
        upto = np.cumsum(flags)
        near = upto[period : period + len(self.hashed)] - upto[: len(self.hashed)] > 0
        self.where = np.flatnonzero(near & (self.left >= self.window))
        first = _hashes(self.where, self.hashed, self.window, 0)
        second = _hashes(self.where, self.hashed, self.window, 1) >> np.uint64(32)
        order = np.lexsort((second, first))  # stable: documents ascend within equal windows
        first, second = first[order], second[order]
        new = np.ones(len(order), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.first, self.second = first[new], second[new].astype(np.uint32)
        self.least = self.keys[self.doc[self.where[order[new]]]]

    def removed(self, smaller: np.ndarray) -> np.ndarray:
        """Which words are covered by a window that a smaller id has too."""
        gone = smaller[self.group] | (self.keys[self.doc[self.where]] > self.least[self.group])
        edges = np.zeros(len(self.hashed) + 1, np.int64)
        edges[self.where[gone]] += 1  # no window starts twice
        edges[self.where[gone] + self.window] -= 1
        return np.cumsum(edges[:-1]) > 0


def _bits(replies: pa.Table, kind: int, n: int) -> np.ndarray:
    rows = sorted((r for r in replies.to_pylist() if r["kind"] == kind), key=lambda r: r["receiver"])
    got = [np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]).astype(bool) for r in rows]
    out = np.concatenate([*got, np.zeros(0, bool)])
    if len(out) != n:
        raise ValueError(f"{len(out)} answers for {n} hashes")
    return out


def _blobs(sender: int, receivers: range, cuts: np.ndarray, pack, more=None) -> pa.Table:
    """A row for each receiver that gets anything: what lies between its cuts."""
    full = [k for k in range(len(receivers)) if cuts[k + 1] > cuts[k]]
    between = [(int(cuts[k]), int(cuts[k + 1])) for k in full]
    return pa.table({"sender": pa.array([sender] * len(full), pa.int64()), "receiver": pa.array([receivers[k] for k in full], pa.int64()), "n": pa.array([b - a for a, b in between], pa.int64()), "blob": pa.array([pack(a, b) for a, b in between], pa.binary()), "more": pa.array([more(a, b) if more else None for a, b in between], pa.binary())})


def _replies(rows: list[dict], kind: int, flags: np.ndarray) -> pa.Table:
    """Each row's share of the answers, a bit for each hash."""
    bits, at = [], 0
    for r in rows:
        bits.append(np.packbits(flags[at : at + r["n"]]).tobytes())
        at += r["n"]
    return pa.table({"sender": pa.array([r["sender"] for r in rows], pa.int64()), "kind": pa.array([kind] * len(rows), pa.int32()), "receiver": pa.array([r["receiver"] for r in rows], pa.int64()), "n": pa.array([r["n"] for r in rows], pa.int64()), "bits": pa.array(bits, pa.binary())})


class _Anchors:
    """Anchors that some senders have: values distinct and sorted; index of each sender's ones in them, in the order of rows."""

    kind, bits = 0, ANCHOR_BITS

    def __init__(self, t: pa.Table):
        self.rows = sorted(t.to_pylist(), key=lambda r: r["sender"])
        self.keys, self.index, counts = np.unique(np.concatenate([ungolomb(r["blob"]) for r in self.rows]), return_inverse=True, return_counts=True)
        repeated = np.concatenate([np.unpackbits(np.frombuffer(r["more"], np.uint8), count=r["n"]) if r["more"] else np.zeros(r["n"], np.uint8) for r in self.rows])
        self.shared = (counts > 1) | (np.bincount(self.index, weights=repeated, minlength=len(self.keys)) > 0)

    def pack(self, a: int, b: int) -> bytes:
        return golomb(self.keys[a:b])

    def more(self, a: int, b: int) -> bytes:
        return np.packbits(self.shared[a:b]).tobytes()

    def of_owner(self) -> np.ndarray:
        return self.shared[self.index]

    def of_relay(self, answers: np.ndarray) -> np.ndarray:
        return answers[self.index]


def _pack_windows(first: np.ndarray, second: np.ndarray, least: np.ndarray) -> bytes:
    """Sorted first hashes as gaps; the others as they are."""
    head = golomb(first)
    return np.uint32(len(head)).tobytes() + head + second.tobytes() + least.tobytes()


def _unpack_windows(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = 4 + int(np.frombuffer(blob, "<u4", 1)[0])
    return ungolomb(blob[4:at]), np.frombuffer(blob, "<u4", n, at), np.frombuffer(blob, "<i8", n, at + 4 * n)


class _Windows:
    """The same for windows: two hashes, and the smallest id that has them. What is asked: does a smaller id have one too?"""

    kind, bits = 1, 64

    def __init__(self, t: pa.Table):
        self.rows = sorted(t.to_pylist(), key=lambda r: r["sender"])
        first, second, self.own = (np.concatenate(x) for x in zip(*(_unpack_windows(r["blob"], r["n"]) for r in self.rows), strict=True))
        order = np.lexsort((self.own, second, first))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)
        self.index = np.empty(len(order), np.int64)
        self.index[order] = np.cumsum(new) - 1
        self.keys, self.second, self.least = first[order][new], second[order][new], self.own[order][new]

    def pack(self, a: int, b: int) -> bytes:
        return _pack_windows(self.keys[a:b], self.second[a:b], self.least[a:b])

    more = None

    def of_owner(self) -> np.ndarray:
        return self.least[self.index] < self.own

    def of_relay(self, answers: np.ndarray) -> np.ndarray:
        """A smaller id than the least of the relay's parts, or than the part's own among these."""
        return answers[self.index] | self.of_owner()


def _exchange(sent: DataFrame, held: type, parts: int, root: int) -> DataFrame:
    """REPLY to what parts have sent to groups of owners, by way of relays."""
    each = math.ceil(parts / root)  # owners in a group; groups are root

    def relay(key: tuple, t: pa.Table) -> pa.Table:
        own, group = held(t), key[0].as_py() % root
        owners = range(group * each, (group + 1) * each)
        bounds = [((1 << own.bits) * b) // (root * each) for b in owners][1:]
        cuts = np.concatenate([[0], np.searchsorted(own.keys, np.array(bounds, np.uint64)), [len(own.keys)]])
        return _blobs(key[0].as_py(), owners, cuts, own.pack, own.more)

    def owner(t: pa.Table) -> pa.Table:
        own = held(t)
        return _replies(own.rows, held.kind, own.of_owner())

    def back(key: tuple, t: pa.Table, replies: pa.Table) -> pa.Table:
        own = held(t)
        return _replies(own.rows, held.kind, own.of_relay(_bits(replies, held.kind, len(own.keys))))

    relays = (F.floor(F.col("sender") / root) * root + F.col("receiver")).cast("long").alias("relay")
    by_relay = sent.select("*", relays).repartition(parts, "relay").groupBy("relay")
    owned = by_relay.applyInArrow(relay, BLOB).repartition(parts, "receiver").groupBy("receiver").applyInArrow(owner, REPLY)
    return by_relay.cogroup(owned.groupBy("sender")).applyInArrow(back, REPLY)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, part_bytes: int | None = None) -> DataFrame:
    """doc_id, n_words, removed (array of word ranges start, end), kept_text (kept words joined by one space).

    A word goes if a window of so many words covers it whose words also start in a document with a smaller id.
    """
    rows = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    total = text_bytes(rows)
    size = part_bytes or max(LEAST_PART, math.ceil(total / MOST_PARTS))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / size))
    root = math.ceil(math.sqrt(parts))
    keyed = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).alias("part"), "doc_id", "text")
    by_part = keyed.repartition(parts, "part").groupBy("part")

    def send_anchors(key: tuple, t: pa.Table) -> pa.Table:
        p = _Part(t, window)
        p.anchors()
        return _blobs(key[0].as_py(), range(root), bucket_cuts(p.unique, root, ANCHOR_BITS), lambda a, b: golomb(p.unique[a:b]))

    def matched(t: pa.Table, replies: pa.Table) -> _Part:
        p = _Part(t, window)
        p.anchors()
        p.candidates(_bits(replies, 0, len(p.unique)) | p.own)
        return p

    def send_windows(key: tuple, t: pa.Table, replies: pa.Table) -> pa.Table:
        p = matched(t, replies)
        return _blobs(key[0].as_py(), range(root), bucket_cuts(p.first, root, 64), lambda a, b: _pack_windows(p.first[a:b], p.second[a:b], p.least[a:b]))

    def cut_words(key: tuple, t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "removed": pa.array([], spans), "kept_text": pa.array([], pa.string())})
        p = matched(t, replies)
        gone = p.removed(_bits(replies, 1, len(p.first)))
        ranges, kept = [], []
        for i, text in enumerate(p.texts):
            own = gone[p.starts[i] : p.starts[i + 1]]
            found = words(text)
            if own.any():
                edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).tolist()
                ranges.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                found = [found[k] for k in np.flatnonzero(~own)]
            else:
                ranges.append([])
            kept.append(b" ".join(found).decode())
        return pa.table({"doc_id": pa.array(p.ids, pa.int64()), "n_words": pa.array(p.n_words), "removed": pa.array(ranges, spans), "kept_text": pa.array(kept, pa.string())})

    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    shared = _exchange(by_part.applyInArrow(send_anchors, BLOB), _Anchors, parts, root)
    sent = by_part.cogroup(shared.groupBy("sender")).applyInArrow(send_windows, BLOB)
    answers = shared.unionByName(_exchange(sent, _Windows, parts, root))
    return by_part.cogroup(answers.groupBy("sender")).applyInArrow(cut_words, "doc_id long, n_words long, removed array<struct<start:long,end:long>>, kept_text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return out.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w WHERE len(ws) >= 13)
), hit AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY win) AS least FROM g) WHERE least < doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT q) AS qs FROM (SELECT doc_id, unnest(range(p, p + 13)) AS q FROM hit) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(qs), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN qs IS NULL THEN ws ELSE
         list_filter(ws, lambda w, i: NOT list_contains(qs, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
