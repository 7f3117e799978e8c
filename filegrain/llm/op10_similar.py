"""Op10 for a given similarity: near duplicates by SimHash with deletion variants, decided on word shingles.

Distinct texts are nodes. Their fingerprints are op10's, of PRINT_WORDS words: an equality join on halves with one
wildcard bit meets every two within 3 bits, and each of a forest of these links is decided on the sets of shingles
themselves. Fingerprints can't reach all: at a similarity of 0.8 they differ in up to 13 of 64 bits (README has the figures),
for which no one-wildcard segments are selective.

So there is a way for the rest, which compares only what fingerprints have not joined: nodes that share one of
BANDS keys, each made of ROWS minima of the set under random orders. A pair at similarity s shares none with a chance of
(1 - s^ROWS)^BANDS, 5 in a million at 0.8. Each such pair, too, is decided on the sets.

No bucket emits its pairs. First each of its nodes is compared with its least one, the pivot, unless fingerprints have
joined both to one node. Buckets that hold more than one group after that are sent with their sets, a set once for each such
bucket, and emit a forest of their links; a task holds one of them at a time, in memory that follows its size.

Defined results: null text is empty; texts of at most so many words as a shingle has are one shingle, empty ones are
alike. Of a group the row with the smallest id stays (null ids last, then by a hash of the text); of rows that repeat
both id and text one stays. Very long texts are compared whole. An empty table gives an empty one; columns of docs,
whatever their names, stay as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at, checkpointed, named, numbered, pick
from .op10_simhash import KEYED_ROWS, components, fingerprint, near_links
from .op8_token_files import pieces

WORDS = 5
LEAST = 0.8
#: Words of a fingerprint's shingles. An edit changes fewer short ones, so more similar texts lie within 3 bits (README); single words meet too many others.
PRINT_WORDS = 2
BANDS, ROWS = 40, 6
SEED = 42
BROADCAST_ROWS = 500_000
_RANDOM = np.random.default_rng(SEED)
FACTORS = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, one at least."""
    split = text.encode().lower().split() if text else []
    norm = b" ".join(split)
    if len(split) <= words:
        return np.array([xxhash.xxh64_intdigest(norm, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in split])
    starts = np.concatenate([[0], ends])[: len(split) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(norm[s:e], SEED) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts)))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """[sets, BANDS]: the keys of sets of hashes."""
    joined = np.concatenate(sets)
    low = (joined ^ (joined >> np.uint64(32))).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, np.uint64) * MIX
        for j in range(band * ROWS, (band + 1) * ROWS):
            key = (key ^ np.minimum.reduceat(low * FACTORS[j] + OFFSETS[j], starts)) * MIX
            key ^= key >> np.uint64(29)
        out[:, band] = key
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return pick(docs, doc_id=(id_col, "long"), text=(text_col, "string")).withColumn("node", _node("text"))


def _node(text: str):
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _sketches(rows: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for a, b in pieces(batch.column("text"), 1 << 20):
                texts = batch.column("text").slice(a, b - a).to_pylist()
                sets = [shingles(t, words) for t in texts]
                prints = np.array([fingerprint(t, PRINT_WORDS) for t in texts], np.uint64).view(np.int64)
                keys = band_keys(sets).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(a, b - a), "node": batch.column("node").slice(a, b - a), "fp": pa.array(prints), "size": pa.array([len(s) for s in sets], pa.int64()), "keys": lists})

    return rows.mapInArrow(run, "doc_id long, node long, fp long, size long, keys array<long>")


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """node, hashes of each distinct text."""

    def run(batches):
        for batch in batches:
            for a, b in pieces(batch.column("text"), 1 << 20):
                sets = [shingles(t, words) for t in batch.column("text").slice(a, b - a).to_pylist()]
                bounds = np.cumsum([0, *map(len, sets)])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.record_batch({"node": batch.column("node").slice(a, b - a), "hashes": lists})

    return rows.select("node", "text").mapInArrow(run, "node long, hashes array<long>").groupBy("node").agg(F.first("hashes").alias("hashes"))


def _buckets(batches):
    """The rows of batches sorted by key, a bucket at a time: its columns as arrays, without key."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy()
        cuts = (np.flatnonzero(np.diff(keys)) + 1).tolist()
        if kept and kept[-1].column("key")[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(kept), [0]
            kept = []
        if not cuts:
            kept.append(batch)
            continue
        whole = pa.Table.from_batches([*kept, batch.slice(0, cuts[-1])])
        held = sum(b.num_rows for b in kept)
        yield whole, [0, *[c + held for c in cuts[:-1]]]
        kept = [batch.slice(cuts[-1])]
    if kept:
        yield pa.Table.from_batches(kept), [0]


def _pivots(batches):
    """Rows (sorted by key, then node) of buckets of two and more nodes, with the bucket's least node."""
    for rows, starts in _buckets(batches):
        starts = np.array(starts)
        size = np.diff(np.append(starts, rows.num_rows))
        many = np.repeat(size > 1, size)
        pivot, pivot_size = (np.repeat(rows.column(c).to_numpy()[starts], size)[many] for c in ("node", "size"))
        yield pa.RecordBatch.from_arrays([*[pa.array(rows.column(c).to_numpy()[many]) for c in ("key", "node", "size")], pa.array(pivot), pa.array(pivot_size)], ["key", "node", "size", "pivot", "pivot_size"])


def _links(least: float):
    def run(batches):
        """Rows (sorted by key): links that join what is similar in a bucket and not of one group yet."""
        for rows, starts in _buckets(batches):
            node, label = rows.column("node").to_numpy(), rows.column("label").to_numpy()
            a, b = [], []
            for s, e in zip(starts, [*starts[1:], rows.num_rows], strict=True):
                for i, j in similar_pairs(rows.column("hashes").slice(s, e - s).combine_chunks(), label[s:e], least):
                    a.append(min(node[s + i], node[s + j]))
                    b.append(max(node[s + i], node[s + j]))
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def similar_pairs(lists: pa.ListArray, label: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of the sets at the similarity that join the same rows as all of them and equal labels do."""
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    size, n = np.diff(bounds), len(bounds) - 1
    hashes = lists.flatten().to_numpy()
    number = np.unique(hashes, return_inverse=True)[1]
    owner = np.repeat(np.arange(n), size)
    by_hash = owner[np.argsort(number, kind="stable")]
    ends = np.cumsum(np.bincount(number))
    group, out = np.unique(label, return_inverse=True)[1], []
    for i in range(n - 1):
        if (group[i + 1 :] == group[i]).all():
            continue
        own = number[bounds[i] : bounds[i + 1]]
        stop = ends[own]
        length = stop - np.where(own > 0, ends[own - 1], 0)
        first = np.cumsum(length) - length
        common = np.bincount(by_hash[np.repeat(stop - length - first, length) + np.arange(length.sum())], minlength=n)
        for j in (np.flatnonzero(common[i + 1 :] >= least * (size[i] + size[i + 1 :] - common[i + 1 :]) - 1e-9) + i + 1).tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                out.append((i, j))
    return out


def _among(df: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of df whose node is among asked (cheap to read: it is counted first)."""
    return df.join(F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked, "node", "left_semi")


def close_pairs(sketches: DataFrame) -> DataFrame:
    """a < b: nodes whose fingerprints are equal or within 3 bits, so many that they join the same nodes as all such pairs do."""
    prints = checkpointed(sketches.groupBy("fp").agg(F.min("node").alias("first")))
    same = sketches.select("fp", "node").distinct().join(prints, "fp").select(F.col("first").alias("x"), F.col("node").alias("y"))
    of = lambda end, name: prints.select(F.col("fp").alias(end), F.col("first").alias(name))
    near = near_links(prints.select("fp")).join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y")
    return same.unionByName(near).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _decided(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity."""
    both = pairs.join(sets.toDF("a", "of_a"), "a").join(sets.toDF("b", "of_b"), "b").withColumn("common", F.size(F.array_intersect("of_a", "of_b")))
    return both.where(F.col("common") >= least * (F.size("of_a") + F.size("of_b") - F.col("common")) - 1e-9).select("a", "b")


def _labels(star: DataFrame) -> DataFrame:
    """node, label: the least node that it is linked with, of those below it."""
    return star.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))


def _open(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) that have no label in common yet."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n: the distinct rows of docs and how often each occurs), (node, root: nodes that have a near copy)."""
    rows = _rows(docs, id_col, text_col)
    sketches = checkpointed(_sketches(rows, words))
    distinct = checkpointed(sketches.groupBy("doc_id", "node").agg(F.count("*").alias("n")))
    nodes = sketches.groupBy("node").agg(F.first("size").alias("size"), F.first("keys").alias("keys"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(distinct.count() / KEYED_ROWS))
    keyed = nodes.select(F.explode("keys").alias("key"), "node", "size").repartition(parts, "key").sortWithinPartitions("key", "node")
    buckets = checkpointed(keyed.mapInArrow(_pivots, "key long, node long, size long, pivot long, pivot_size long"))
    close = checkpointed(close_pairs(sketches))
    asked = buckets.select("node").unionByName(close.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    sets = checkpointed(_sets(_among(rows, asked), words))
    by_prints = checkpointed(_decided(close, sets, least))
    pairs = buckets.where("node <> pivot").where(F.least("size", "pivot_size") >= least * F.greatest("size", "pivot_size") - 1e-9).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    star = checkpointed(by_prints.unionByName(_decided(_open(pairs, _labels(by_prints)), sets, least)))
    # What is not joined by one pivot: buckets of more than one label, without their pivots, which are compared already.
    labels = _labels(star)
    placed = buckets.join(labels, "node", "left").select("key", "node", "pivot", F.least("node", "label").alias("label"))
    rest = placed.where("node <> pivot").join(several(placed.where("node <> pivot")), "key", "left_semi")
    rest = rest.select("key", "node", "label").join(sets, "node").repartition(parts, "key").sortWithinPartitions("key", "node")
    links = star.unionByName(rest.mapInArrow(_links(least), "a long, b long")).distinct()
    return distinct, components(links)


def several(placed: DataFrame) -> DataFrame:
    """Keys of buckets with more than one label."""
    return placed.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """The rows of docs without near copies: of each group, the row with the smallest id."""
    distinct, root = groups(docs, id_col, text_col, words, least)
    placed = distinct.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("node"))
    # Joined by the rows that stay, one for each group, and not by the group, so that no large group meets in a task.
    first = placed.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.doc_id").alias("first_id"), F.col("first.node").alias("first_node"))
    joined = distinct.join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("node") == F.col("first_node")), "left")
    judged = joined.select(F.col("doc_id").alias("judged_id"), F.col("node").alias("judged_node"), "n", F.col("first_node").isNotNull().alias("stays"))
    judged = checkpointed(judged.where("NOT stays OR n > 1"))
    gone, repeated = judged.where("NOT stays").select("judged_id", "judged_node"), judged.where("stays").select("judged_id", "judged_node")
    size = {r["stays"]: r["k"] for r in judged.groupBy("stays").agg(F.count("*").alias("k")).collect()}
    id_ = F.col(at(docs, id_col)).cast("long")
    rows = numbered(docs).withColumns({"own_id": id_, "node": _node(at(docs, text_col))})
    same = F.col("own_id").eqNullSafe(F.col("judged_id")) & (F.col("node") == F.col("judged_node"))
    out = rows.join(F.broadcast(gone) if size.get(False, 0) <= BROADCAST_ROWS else gone, same, "left_anti")
    if size.get(True):
        repeated = F.broadcast(repeated) if size[True] <= BROADCAST_ROWS else repeated
        out = out.join(repeated, same, "left_anti").unionByName(out.join(repeated, same, "left_semi").dropDuplicates(["own_id", "node"]))
    return named(docs, out)
