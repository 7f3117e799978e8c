"""SimHash near-dedup with deletion-variant signatures.

Fingerprints of 64 bits link at 3 or fewer differing bits. Cut into two halves (fewer than the four that equal
segments would need), one half differs by one bit at most. Each half is indexed under 32 variants with one bit
left out ("wildcard"): halves that differ in one bit share the variant without that bit, equal halves share all.
An equality join on (half, wildcard, rest) therefore meets every link, and candidates are verified on all bits.

No bucket emits its pairs: it emits a spanning forest of its links, found in memory that follows the bucket's
size, by comparing all rows in blocks or, where cheaper, by looking up every fingerprint of the bucket at each of
the masks of up to 3 bits that its open bits allow. Buckets above HOT_ROWS distinct fingerprints are dealt again
by one-wildcard variants of the quarters of the other half (again, one of two differs by one bit at most), which
leaves 18 open bits and so bounds a bucket at 2^18 rows. Equal fingerprints are one node from the start.
Components of the forest come from alternating large-star and small-star rounds, whose tables are checkpointed.

Fingerprints of more than HOT_PRINTS rows (copies, empty texts) get their component from a list that goes to every
task: there is one such for each HOT_PRINTS rows at most. The centre of a star has a row for each of its neighbours in
a join of the rounds (16 bytes each, distinct fingerprints only), whose partition adaptive execution splits.

Defined results: null text has no words, fingerprint zero, and links like any other. Rows that repeat an id are
rows each; component_id is the smallest id in the component (null only if all ids there are null). Very long texts are
read whole. An empty table gives an empty one. Other columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, pick, table

SEED = 42
BITS = 64
MOST = 3
#: Distinct fingerprints in a bucket above which it is dealt again by a second signature.
HOT_ROWS = 4096
#: Rows of one fingerprint above which its component goes to every task.
HOT_PRINTS = 100_000
#: Fingerprints in a partition that is expanded to 64 keys each.
KEYED_ROWS = 50_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bit by bit: is it set in over half of the XXH64 of the text's shingles? Zero without words."""
    norm = b" ".join(text.encode().lower().split()) if text else b""
    if not norm:
        return 0
    raw = np.frombuffer(norm, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(norm)]
    if len(starts) <= shingle:
        return xxhash.xxh64_intdigest(norm, SEED)
    digest, n = xxhash.xxh64_intdigest, len(starts) - shingle + 1
    counts = np.zeros(BITS, np.int64)
    for a in range(0, n, 1 << 16):  # very long texts
        b = min(n, a + (1 << 16))
        h = np.fromiter((digest(norm[s:e], SEED) for s, e in zip(starts[a:b], ends[a + shingle - 1 : b + shingle - 1])), "<u8", b - a)  # noqa: B905
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp (64 bits as a long); a row for each row of docs."""

    def run(batches):
        for batch in batches:
            out = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(np.array(out, np.uint64).view(np.int64))})

    return pick(docs, doc_id=(id_col, "long"), text=(text_col, "string")).mapInArrow(run, "doc_id long, fp long")


def variants(values: np.ndarray, offset: int, width: int) -> np.ndarray:
    """[rows, width]: the segment of so many bits at offset, for each of its bits left out."""
    segment = (values >> np.uint64(offset)) & np.uint64((1 << width) - 1)
    return segment[:, None] & ~(np.uint64(1) << np.arange(width, dtype=np.uint64))


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= most


def forest(values: np.ndarray, most: int = MOST) -> list[tuple[int, int]]:
    """Index pairs that join the same rows as all links between distinct values, each a real link."""
    n = len(values)
    if n < 2:
        return []
    open_bits = np.flatnonzero((np.bitwise_or.reduce(values) ^ np.bitwise_and.reduce(values)) >> np.arange(64, dtype=np.uint64) & np.uint64(1))
    masks = sum(1 for k in range(1, most + 1) for _ in combinations(range(len(open_bits)), k)) if n > 512 else 1 << 60
    unseen = np.arange(n)
    out: list[tuple[int, int]] = []
    if n <= 4 * masks:  # breadth first: every row is once compared with the rows not reached yet
        while len(unseen):
            front, unseen = [int(unseen[0])], unseen[1:]
            while front and len(unseen):
                at = front.pop()
                hit = _near(values[unseen], values[at], most)
                if hit.any():
                    found = unseen[hit].tolist()
                    out += [(at, x) for x in found]
                    front += found
                    unseen = unseen[~hit]
        return out
    order = np.argsort(values)
    ordered = values[order]
    parent = np.arange(n)
    for k in range(1, most + 1):
        for chosen in combinations(open_bits.tolist(), k):
            other = values ^ np.uint64(sum(1 << b for b in chosen))
            place = np.minimum(np.searchsorted(ordered, other), n - 1)
            hit = np.flatnonzero(ordered[place] == other)
            for a, b in zip(hit.tolist(), order[place[hit]].tolist(), strict=True):
                if a < b:
                    ra, rb = _root(parent, a), _root(parent, b)
                    if ra != rb:
                        parent[max(ra, rb)] = min(ra, rb)
                        out.append((a, b))
    return out


def _root(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = int(parent[x])
    return x


def _keys(nodes: DataFrame) -> DataFrame:
    """key, fp: the 64 one-wildcard variants of each fingerprint's halves."""

    def run(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for a in range(0, len(fps), 4096):
                v = fps[a : a + 4096]
                keys = [(variants(v, 32 * half, 32) << np.uint64(6)) | np.arange(32 * half, 32 * half + 32, dtype=np.uint64) for half in (0, 1)]
                keys = np.concatenate(keys, axis=1)
                yield pa.record_batch({"key": pa.array(keys.ravel().view(np.int64)), "fp": pa.array(np.repeat(v, keys.shape[1]).view(np.int64))})

    # 64 rows of each: dealt out by their number, since the few bytes of fingerprints alone make few partitions.
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(nodes.count() / KEYED_ROWS))
    return nodes.select("fp").repartition(parts, "fp").mapInArrow(run, "key long, fp long")


def _deal_again(rows: DataFrame) -> DataFrame:
    """key, sub, fp for rows of hot keys: 32 one-wildcard variants of the quarters of the half that key leaves open."""

    def run(batches):
        for batch in batches:
            keys, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            other = np.where((keys & 63) < 32, fps >> np.uint64(32), fps & np.uint64(0xFFFFFFFF))
            sub = [(variants(other, 16 * q, 16) << np.uint64(5)) | np.arange(16 * q, 16 * q + 16, dtype=np.uint64) for q in (0, 1)]
            sub = np.concatenate(sub, axis=1)
            yield pa.record_batch({"key": pa.array(np.repeat(keys, 32)), "sub": pa.array(sub.ravel().view(np.int64)), "fp": pa.array(np.repeat(fps, 32).view(np.int64))})

    return rows.mapInArrow(run, "key long, sub long, fp long")


def _links(t: pa.Table) -> pa.Table:
    fps = np.unique(t.column("fp").to_numpy().view(np.uint64))
    pairs = np.array(forest(fps), np.int64).reshape(-1, 2)
    a, b = fps[pairs[:, 0]].view(np.int64), fps[pairs[:, 1]].view(np.int64)
    return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def _bucket_links(most: int):
    def run(batches):
        """Rows sorted by key, in batches: links of each key's bucket, with key null. Of buckets above so many rows the rows (a: fingerprint, key), to be dealt again."""
        kept_key, kept_fp, hot = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        names = ["a", "b", "key"]

        def again(keys: np.ndarray, fps: np.ndarray):
            return pa.record_batch([pa.array(fps), pa.nulls(len(fps), pa.int64()), pa.array(keys)], names)

        def links(keys: np.ndarray, fps: np.ndarray):
            edge = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(keys)]])
            size = ends - starts
            two = starts[size == 2]
            a, b = [fps[two]], [fps[two + 1]]
            hit = _near(a[0].view(np.uint64), b[0].view(np.uint64), MOST) & (a[0] != b[0])
            a, b = [a[0][hit]], [b[0][hit]]
            for s, e in zip(starts[(size > 2) & (size <= most)].tolist(), ends[(size > 2) & (size <= most)].tolist(), strict=True):
                own = np.unique(fps[s:e])
                pairs = np.array(forest(own.view(np.uint64)), np.int64).reshape(-1, 2)
                a.append(own[pairs[:, 0]])
                b.append(own[pairs[:, 1]])
            a, b = np.concatenate(a), np.concatenate(b)
            found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
            yield pa.record_batch([pa.array(found[0]), pa.array(found[1]), pa.nulls(found.shape[1], pa.int64())], names)
            large = np.repeat(size > most, size)
            if large.any():
                yield again(keys[large], fps[large])

        for batch in batches:
            keys = np.concatenate([kept_key, batch.column("key").to_numpy()])
            fps = np.concatenate([kept_fp, batch.column("fp").to_numpy()])
            if hot is not None:  # a bucket that has begun to go out goes on
                own = int(np.searchsorted(keys, hot, "right"))
                yield again(keys[:own], fps[:own])
                keys, fps = keys[own:], fps[own:]
            if not len(keys):
                kept_key, kept_fp = keys, fps
                continue
            hot = None
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield from links(keys[:cut], fps[:cut])
            kept_key, kept_fp = keys[cut:], fps[cut:]
            if len(kept_key) > most:
                hot = kept_key[0]
                yield again(kept_key, kept_fp)
                kept_key, kept_fp = kept_key[:0], kept_fp[:0]
        if len(kept_key):
            yield from links(kept_key, kept_fp)

    return run


def near_links(nodes: DataFrame) -> DataFrame:
    """a < b: links between distinct fingerprints (column fp of nodes, which are read twice) that join the same rows as all links do."""
    keyed = _keys(nodes)
    met = checkpointed(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_links(HOT_ROWS), "a long, b long, key long"))
    again = _deal_again(met.where("key IS NOT NULL").select("key", F.col("a").alias("fp")))
    return met.where("key IS NULL").select("a", "b").unionByName(again.groupBy("key", "sub").applyInArrow(_links, "a long, b long")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for the nodes of edges (a, b); alternating large-star and small-star rounds."""
    edges = checkpointed(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").distinct())
    before, tasks = None, math.ceil(2 * edges.count() / KEYED_ROWS) + 1
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Now each row has a > b: the small star links all smaller neighbours of a, and a, to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m")), F.struct(F.col("a").alias("x"), F.col("m")))).alias("e"))
        # A round has no more edges than the one before it; few of them are written by few tasks.
        edges = checkpointed(linked.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct().coalesce(tasks))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (long), component_id; a row for each row of docs."""
    prints = checkpointed(fingerprints(docs, id_col, text_col))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    member = components(near_links(nodes.select("fp")))
    placed = nodes.join(member, nodes["fp"] == member["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n")
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = placed.join(smallest, "root").select("fp", "component_id", "n")
    if nodes.where(F.col("n") > HOT_PRINTS).isEmpty():
        return prints.join(ids.drop("n"), "fp").select("doc_id", "fp", "component_id")
    hot = ids.where(F.col("n") > HOT_PRINTS).select(F.col("fp").alias("hot"), F.col("component_id").alias("of_hot"))
    rows = prints.join(F.broadcast(hot), prints["fp"] == hot["hot"], "left")
    rest = rows.where("hot IS NULL").select("doc_id", "fp").join(ids.where(F.col("n") <= HOT_PRINTS).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
    return rest.unionByName(rows.where("hot IS NOT NULL").select("doc_id", "fp", F.col("of_hot").alias("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
