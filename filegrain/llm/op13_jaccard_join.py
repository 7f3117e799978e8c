"""N-gram Jaccard join by prefix trees: exact links between sets of word shingles, and their components.

Sets have one global order, rare shingles first, by a count of all shingles in a table of a bounded number of slots (any
order gives right results; this one keeps groups small). Two sets at the similarity share k of their first
n - ceil(s * n) + k shingles. So shingles in such a prefix are the keys where sets meet, with k = n / SHARE; a set that
shares fewer of them with all others together has no link.

No group emits its pairs. Shingles that bring the same sets together count once (the sets' numbers are summed up, by
exclusive or). First each set is compared with the least one of its group, the pivot, which joins a tight group at once;
groups that still hold sets of several components then meet whole, once for all groups that share sets, or group by
group where that moves less. What meets goes to a cell of at most CELL_ROWS sets and about CELL_TOKENS shingles: a
pivot's followers are dealt into several cells, other groups into cells for each two of their blocks, so that all pairs of
sets meet in some cell.

A cell stores its sets, frequent shingles first, in a trie, and walks it once with all sets as probes: a path's overlap
with each probe is shared by all sets below it. A subtree is left out once no probe of another component can
reach the similarity with the shingles that remain in the probe and in the subtree. A cell emits a forest of its links.

Equal texts are one node from the start; their rows meet again only in the last join, by the node, which adaptive
execution splits where a node is frequent. Sets are told apart by 64-bit hashes of shingles, texts by MD5.

Defined results: null and empty texts have no shingles and are linked with nothing, not with each other either. Texts of
fewer words than a shingle are one shingle. Rows that repeat an id are rows each; component_id is the smallest id in the
component (null only if all ids there are null). Very long texts are read whole. An empty table gives an empty one. Other
columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, pick, table, text_bytes
from .op8_token_files import pieces
from .op10_simhash import components

WORDS = 4
PERCENT = 85
#: A cell's limits: sets, and shingles of all its sets.
CELL_ROWS, CELL_TOKENS = 2048, 2 << 20
#: Of a set's tokens one in so many has to be shared within the prefix, which is that much longer.
SHARE = 40
#: Slots of the table of counts: 2^MOST_BITS at most, one byte each where it is broadcast.
LEAST_BITS, MOST_BITS, SLICE_BITS = 12, 22, 12
#: Rows of a list of sets that is broadcast, at most.
BROADCAST_ROWS = 500_000
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """Of each shingle of so many words, in order."""
    split = text.encode().lower().split() if text else []
    if not split:
        return np.zeros(0, np.uint64)
    each = np.frombuffer(b"".join(map(xxhash.xxh64_digest, split)), ">u8").astype(np.uint64)
    width = min(words, len(split))
    n = len(split) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):  # the place of a word counts
        h = (h ^ (h >> np.uint64(32))) * FACTORS[k % 8] + each[k : k + n]
    h = (h ^ (h >> np.uint64(31))) * FACTORS[7]
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of so many words; none without words."""
    return np.unique(hashes(text, words))


def slots(tokens: np.ndarray, size: int) -> np.ndarray:
    """Of a table of so many, a power of two."""
    return (tokens >> np.uint64(16)).astype(np.int64) & (size - 1)


def ordered(tokens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Tokens in the global order: rare ones first."""
    return tokens[np.lexsort((tokens, classes[slots(tokens, len(classes))]))]


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """So many first tokens, in the global order, hold n // SHARE of what a set of n has in common with any similar one (one at least)."""
    return n - (percent * n + 99) // 100 + max(1, n // SHARE) if n else 0


def least_shared(size: str, percent: int = PERCENT):
    """So many tokens of their prefixes two similar sets share, of which one has that size: the smaller one's share counts."""
    return F.greatest(F.lit(1), F.expr(f"(({percent} * {size} + 99) div 100) div {SHARE}"))


def similar(common, one, other, percent: int = PERCENT):
    return 100 * common >= percent * (one + other - common)


# --- the global order


def token_classes(docs: DataFrame, words: int, bits: int) -> np.ndarray:
    """For each of 2^bits slots of tokens, the logarithm of its count in all documents (a task counts up to 255). uint8."""
    cut = min(bits, SLICE_BITS)

    def count(batches):
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for a, b in pieces(batch.column("text"), 4 << 20):
                said = [hashes(t.as_py(), words) for t in batch.column("text").slice(a, b - a)]
                counts += np.bincount(slots(np.concatenate(said), 1 << bits), minlength=1 << bits).astype(np.uint32)
        parts = np.minimum(counts, 255).astype(np.uint8).reshape(-1, 1 << cut)
        for a in range(0, len(parts), 64):
            some = [k for k in range(a, min(len(parts), a + 64)) if parts[k].any()]
            yield pa.record_batch({"slice": pa.array(some, pa.int64()), "counts": pa.array([zlib.compress(parts[k].tobytes(), 1) for k in some], pa.binary())})

    def total(batches):
        key, held = None, None
        for batch in batches:
            for at, counts in zip(batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
                if at != key:
                    if key is not None:
                        yield _class_row(key, held)
                    key, held = at, np.zeros(1 << cut, np.int64)
                held += np.frombuffer(zlib.decompress(counts.as_py()), np.uint8)
        if key is not None:
            yield _class_row(key, held)

    counted = docs.select("text").mapInArrow(count, "slice long, counts binary")
    rows = counted.repartition("slice").sortWithinPartitions("slice").mapInArrow(total, "slice long, counts binary").collect()
    out = np.zeros((1 << (bits - cut), 1 << cut), np.uint8)  # its size is bounded, whatever docs hold
    for r in rows:
        out[r["slice"]] = np.frombuffer(r["counts"], np.uint8)
    return out.ravel()


def _class_row(at: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"slice": pa.array([at], pa.int64()), "counts": pa.array([np.floor(2 * np.log2(counts + 1)).astype(np.uint8).tobytes()])})


# --- cells


def trie_links(sets: list[np.ndarray], group: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs of sets at the similarity that join, with equal groups, the same sets as all such pairs. sets: ascending whole numbers, in one order for all."""
    n = len(sets)
    order = sorted(range(n), key=lambda i: sets[i].astype(">u4").tobytes())
    sets, group = [sets[i] for i in order], np.unique(group, return_inverse=True)[1][order]
    size = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets).astype(np.int64)
    by_token = np.repeat(np.arange(n), size)[np.argsort(tokens, kind="stable")]
    ends = np.cumsum(np.bincount(tokens))
    shared = np.zeros(n + 1, np.int64)  # with the set before
    for i in range(1, n):
        k = min(size[i - 1], size[i])
        differ = np.flatnonzero(sets[i - 1][:k] != sets[i][:k])
        shared[i] = differ[0] if len(differ) else k
    out: list[tuple[int, int]] = []

    def met(segment: np.ndarray) -> np.ndarray:
        """How many of the segment's tokens each set has."""
        if not len(segment):
            return np.zeros(n, np.int64)
        at = segment.astype(np.int64)
        stop = ends[at]
        length = stop - np.where(at > 0, ends[at - 1], 0)
        first = np.cumsum(length) - length
        return np.bincount(by_token[np.repeat(stop - length - first, length) + np.arange(length.sum())], minlength=n)

    def join(i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            if group[i] != group[j]:
                out.append((order[i], order[j]))
                group[group == group[j]] = group[i]

    pivot = n // 2
    common = met(sets[pivot])
    join(pivot, np.flatnonzero(similar(common, size, size[pivot], percent)))
    stack = [(0, n, 0, np.zeros(n, np.int64))] if n > 1 else []
    while stack:
        a, b, depth, overlap = stack.pop()
        if b - a == 1:
            rivals = np.flatnonzero(group[:a] != group[a])
            if len(rivals):
                common = (overlap + met(sets[a][depth:]))[rivals]
                join(a, rivals[similar(common, size[rivals], size[a], percent)])
            continue
        deeper = int(shared[a + 1 : b].min())
        overlap = overlap + met(sets[a][depth:deeper])
        least, most = size[a:b].min(), size[a:b].max()
        probes = np.arange(b - 1)
        if (group[a:b] == group[a]).all():
            probes = probes[group[: b - 1] != group[a]]
        had, own = overlap[probes], size[probes]
        # Of what remains in the subtree and in the probe; the union holds the probe, the shortest set, and the path's other tokens.
        upper = np.minimum(had + most - deeper, own)
        if not (100 * upper >= percent * np.maximum(np.maximum(own, least), own + deeper - had)).any():
            continue
        edges = [a, *(np.flatnonzero(shared[a + 1 : b] == deeper) + a + 1).tolist(), b]
        stack += [(s, e, deeper, overlap) for s, e in zip(edges[:-1], edges[1:], strict=True)]
    return out


def _cell_links(classes, percent: int):
    """Rows sorted by cell (a, b): links between nodes. One cell is held at a time."""

    def links(rows: list[tuple[int, int, bytes]]):
        rows = list({node: (node, label, tokens) for node, label, tokens in rows}.values())
        sets = [np.frombuffer(t, "<u8") for _, _, t in rows]
        joined = np.concatenate(sets)
        # Frequent tokens get small numbers, so that sets share their beginnings.
        order = np.lexsort((joined, classes.value[slots(joined, len(classes.value))]))
        number = np.empty(len(joined), np.int64)
        number[order] = np.cumsum(np.diff(joined[order], prepend=joined[order[:1]]) != 0)
        number = number.max(initial=0) - number
        bounds = np.cumsum([0, *map(len, sets)])
        found = trie_links([np.sort(number[s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)], np.array([label for _, label, _ in rows]), percent)
        pairs = np.array([(rows[i][0], rows[j][0]) for i, j in found], np.int64).reshape(-1, 2)
        return pa.record_batch({"a": pa.array(pairs.min(axis=1, initial=np.iinfo(np.int64).max)), "b": pa.array(pairs.max(axis=1, initial=-1))})

    def run(batches):
        cell, held = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("a", "b", "node", "label", "tokens")]
            for a, b, *row in zip(*columns, strict=True):
                if (a, b) != cell:
                    if len(held) > 1:
                        yield links(held)
                    cell, held = (a, b), []
                held.append(tuple(row))
        if len(held) > 1:
            yield links(held)

    return run


def _met(rows: DataFrame, nodes: DataFrame, wanted: DataFrame, classes, words: int, percent: int) -> DataFrame:
    """a < b: links found in cells. wanted: node, a, b (its cells), label."""
    asked = wanted.groupBy("node", "label").agg(F.collect_list(F.struct("a", "b")).alias("cells")).join(nodes.select("node", "digest", "least"), "node")
    asked = checkpointed(asked.withColumnRenamed("digest", "of_digest"))
    n, total = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("cells")), F.lit(0))).first()
    same = (F.col("digest") == F.col("of_digest")) & F.col("doc_id").eqNullSafe(F.col("least"))
    chosen = rows.join(F.broadcast(asked) if n + total <= BROADCAST_ROWS else asked, same)

    def sets(batches):
        seen = set()
        for batch in batches:
            for a, b in pieces(batch.column("text"), 1 << 20):
                part = batch.slice(a, b - a)
                out = {c: [] for c in ("a", "b", "node", "label", "tokens")}
                for text, node, label, cells in zip(*(part.column(c) for c in ("text", "node", "label", "cells")), strict=True):
                    if node.as_py() in seen:
                        continue
                    seen.add(node.as_py())
                    tokens = shingles(text.as_py(), words).astype("<u8").tobytes()
                    for cell in cells.as_py():
                        for c, v in zip(out, (cell["a"], cell["b"], node.as_py(), label.as_py(), tokens), strict=True):
                            out[c].append(v)
                yield pa.record_batch({c: pa.array(v, pa.binary() if c == "tokens" else pa.int64()) for c, v in out.items()})

    moved = chosen.select("text", "node", "label", "cells").mapInArrow(sets, "a long, b long, node long, label long, tokens binary")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / (8 * CELL_ROWS)))
    dealt = moved.repartition(parts, "a", "b").sortWithinPartitions("a", "b")
    return dealt.mapInArrow(_cell_links(classes, percent), "a long, b long").distinct()


def _pieces_of(rows: str, tokens: str):
    """Cells for so many rows and tokens."""
    return F.greatest(F.ceil(F.col(rows) / CELL_ROWS), F.ceil(F.col(tokens) / CELL_TOKENS), F.lit(1)).cast("long")


def _star_cells(buckets: DataFrame, percent: int) -> DataFrame:
    """node, a, b, label: each pivot with its followers, dealt into as many cells as they need."""
    ratio = 100 * F.least("size", "pivot_size") >= percent * F.greatest("size", "pivot_size")
    pairs = buckets.where((F.col("node") != F.col("pivot")) & ratio).select("pivot", "node", "size").distinct()
    many = pairs.groupBy("pivot").agg(F.count("*").alias("n"), F.sum("size").alias("t")).select("pivot", _pieces_of("n", "t").alias("k"))
    followers = pairs.join(many, "pivot").select("node", F.col("pivot").alias("a"), F.pmod(F.xxhash64("node"), "k").alias("b"))
    pivots = many.select(F.col("pivot").alias("node"), F.col("pivot").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("b"))
    return followers.unionByName(pivots).withColumn("label", F.col("node"))


def _block_cells(groups: DataFrame) -> DataFrame:
    """node, a, b, label: each group (grp, node, size, label) in cells for any two of its blocks, of half a cell each."""
    many = groups.groupBy("grp").agg((2 * F.count("*")).alias("n"), (2 * F.sum("size")).alias("t"))
    many = many.select("grp", F.when((F.col("n") <= 2 * CELL_ROWS) & (F.col("t") <= 2 * CELL_TOKENS), F.lit(1).cast("long")).otherwise(_pieces_of("n", "t")).alias("k"))
    rows = groups.join(many, "grp").withColumn("i", F.pmod(F.xxhash64("node"), "k"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))
    return rows.withColumn("j", others).select("node", F.col("grp").alias("a"), (F.least("i", "j") * F.col("k") + F.greatest("i", "j")).alias("b"), "label")


def _several(rows: DataFrame, key: str) -> DataFrame:
    """Keys of rows with more than one label."""
    return rows.groupBy(key).agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select(key)


def links(rows: DataFrame, nodes: DataFrame, prefixes: DataFrame, classes, words: int, percent: int) -> DataFrame:
    """a < b: links between nodes that join the same nodes as all links do. rows: doc_id, digest, text; nodes: node, digest, least, size; prefixes: node, size, token."""
    met = prefixes.groupBy("token").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("token")
    shared = checkpointed(prefixes.join(met, "token"))
    enough = shared.groupBy("node", "size").agg(F.count("*").alias("n")).where(F.col("n") >= least_shared("size", percent)).select("node")
    kept = shared.join(enough, "node", "left_semi")
    # The nodes that a token brings together, by their number, ends and sum: tokens with equal ones bring the same together.
    alike = kept.groupBy("token").agg(F.min("node").alias("pivot"), F.max("node").alias("last"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("sum")).where("pivot <> last")
    once = alike.groupBy("pivot", "last", "n", "sum").agg(F.min("token").alias("token"), F.count("*").alias("weight")).select("token", "pivot", "weight")
    held = kept.join(once, "token").join(nodes.select(F.col("node").alias("pivot"), F.col("size").alias("pivot_size")), "pivot")
    buckets = checkpointed(held.select("token", "weight", "node", "size", "pivot", "pivot_size"))
    star = checkpointed(_met(rows, nodes, _star_cells(buckets, percent), classes, words, percent))
    labels = components(star)
    placed = buckets.where("node <> pivot").join(labels, "node", "left").select("token", "weight", "node", "size", F.coalesce("root", "node").alias("label"))
    several = checkpointed(placed.join(_several(placed, "token"), "token", "left_semi"))
    enough = several.groupBy("node", "size").agg(F.sum("weight").alias("n")).where(F.col("n") >= least_shared("size", percent)).select("node")
    rest = checkpointed(several.drop("weight").join(enough, "node", "left_semi"))
    if rest.isEmpty():
        return star
    # Groups that share nodes are one larger group, in which a node moves once for each block.
    least = rest.groupBy("token").agg(F.min("node").alias("first"))
    wider = components(rest.join(least, "token").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())
    grouped = rest.join(least, "token").join(wider.select(F.col("node").alias("first"), F.col("root").alias("whole")), "first", "left").withColumn("whole", F.coalesce("whole", "first")).drop("first")
    nodes_of = grouped.select("whole", "node", "size", "label").distinct()
    cost = nodes_of.groupBy("whole").agg(F.count("*").alias("n"), F.sum("size").alias("t")).select("whole", (F.col("n") * _pieces_of("n", "t")).alias("as_one"))
    apart = grouped.groupBy("whole").agg(F.count("*").alias("as_many")).join(cost, "whole").select("whole", (F.col("as_one") <= F.col("as_many")).alias("one"))
    as_one = nodes_of.join(apart.where("one"), "whole").select(F.xxhash64("whole", F.lit(1)).alias("grp"), "node", "size", "label")
    as_many = grouped.join(apart.where("NOT one"), "whole").select(F.xxhash64("token", F.lit(2)).alias("grp"), "node", "size", "label")
    return star.unionByName(_met(rows, nodes, _block_cells(as_one.unionByName(as_many)), classes, words, percent)).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id; a row for each row of docs."""
    spark = docs.sparkSession
    rows = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string")).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("digest", F.unhex(F.md5("text")))
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(1 + text_bytes(docs, text_col) / 64))))
    classes = spark.sparkContext.broadcast(token_classes(rows, words, bits))

    def sketch(batches):
        for batch in batches:
            for a, b in pieces(batch.column("text"), 1 << 20):
                sets = [shingles(t.as_py(), words) for t in batch.column("text").slice(a, b - a)]
                firsts = [ordered(s, classes.value)[: prefix_size(len(s), percent)].view(np.int64) for s in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, firsts)]), pa.int32()), pa.array(np.concatenate(firsts)))
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(a, b - a), "digest": batch.column("digest").slice(a, b - a), "size": pa.array([len(s) for s in sets], pa.int64()), "firsts": lists})

    sketches = checkpointed(rows.select("doc_id", "digest", "text").mapInArrow(sketch, "doc_id long, digest binary, size long, firsts array<long>"))
    own = sketches.where("size > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("firsts").alias("firsts"))
    nodes = checkpointed(own.withColumn("node", F.monotonically_increasing_id()))
    found = links(rows, nodes.drop("firsts"), nodes.select("node", "size", F.explode("firsts").alias("token")), classes, words, percent)
    placed = nodes.join(components(found), "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = placed.join(smallest, "root").select(F.col("digest").alias("of_digest"), "component_id")
    out = sketches.join(ids, sketches["digest"] == ids["of_digest"], "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
