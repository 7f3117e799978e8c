"""Hard-negative mining by ball-tree branch-and-bound.

Rows are dealt into parts, and each part becomes one ball tree (TREE_BYTES of it at most), written once. Anchors, a
stated query set, meet all trees in blocks: a cell is one tree and at most BLOCK anchors, and tasks stream over cells,
with one tree and one block in memory. A node's ball bounds inner products on both sides, q.c - |q| r <= q.x <= q.c + |q| r.
A search keeps, for each anchor and each window of scores, the best rows so far; it leaves out a node for an anchor if
no window can meet it: its upper bound lies below the window or strictly below the current kth score, or its lower bound
lies above the window. Leaves compare whole blocks by one matrix product. What a cell has found is at most k rows for
each anchor and window; a ranking over all cells keeps the k best.

Two searches follow each other: the first, with one open window, finds each anchor's positives; the second, with a window
for each positive's score, finds negatives.

Scores are whole numbers, computed exactly: as doubles while no product can reach 2^53, else as Python's integers without
pruning (a score beyond 64 bits is stored as the nearest long). Bounds have slack for rounding, so they never prune a
row that counts.

Defined results: rows with a null label, a null vector, or a null or non-finite component (also after the scaling) take
no part. Vectors of different lengths have no score with each other. A null id is no anchor; as a candidate it comes after
all ids at equal scores. Rows that repeat an id, or all columns, are rows each: an anchor's other rows are all rows
but itself, and a repeated anchor has results for each of its rows. Anchors without positives, and positives without
negatives in their window, have no rows. An empty table gives an empty one. Other columns are not read.
A frequent vector, label or id costs nothing special: parts are dealt by row, and what passes on is at most k rows a cell.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, checkpointed, pick, table

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score over its positive's lies between these, in hundredths.
LEAST_PERCENT, MOST_PERCENT = 50, 95
LEAF = 128
#: Bytes of vectors in a tree, at 8 for a component; and rows below which a part isn't cut further.
TREE_BYTES, LEAST_ROWS = 32 << 20, 2048
#: Anchors in a block.
BLOCK = 16_384
MOST_TASKS = 50_000
EXACT = float(1 << 53)
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """row (a number of its own), id, label, vector (whole numbers, as array<double>) of rows that take part."""
    kept = pick(df, id=(id_col, "long"), label=(label_col, "long"), vector=(vector_col, "array<double>")).where("label IS NOT NULL AND vector IS NOT NULL")
    whole = kept.withColumn("vector", F.transform("vector", lambda x: x * F.lit(float(scale))))
    whole = whole.where(F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    # From 2^53 on doubles are whole numbers already, and floor's long would end.
    return whole.withColumn("vector", F.transform("vector", lambda x: F.when(F.abs(x) >= EXACT, x).otherwise(F.floor(x).cast("double")))).withColumn("row", F.monotonically_increasing_id())


class Tree:
    """Balls over the rows of a matrix: nodes as (first, end, centre, radius, children), rows in tree order."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.nodes: list[tuple[int, int, np.ndarray, float, tuple[int, int] | None]] = []
        self._grow(points, 0, len(points), leaf)
        self.points = points[self.order]

    def _grow(self, points: np.ndarray, a: int, b: int, leaf: int) -> int:
        own = points[self.order[a:b]]
        centre = own.mean(axis=0)
        gap = own - centre
        far = np.einsum("ij,ij->i", gap, gap)
        at = len(self.nodes)
        self.nodes.append((a, b, centre, math.sqrt(float(far.max())) * (1 + 1e-9), None))
        if b - a > leaf and far.max() > 0:
            # Split by the direction between two far rows, halves of equal size: depth is logarithmic whatever the data.
            one = own[int(far.argmax())]
            other = own[int(np.einsum("ij,ij->i", own - one, own - one).argmax())]
            half = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own @ (one - other), half)]
            left = self._grow(points, a, a + half, leaf)
            right = self._grow(points, a + half, b, leaf)
            self.nodes[at] = (*self.nodes[at][:4], (left, right))
        return at


class Search:
    """The k best rows of a tree for each anchor and window. negative: other labels count instead of the anchor's own."""

    def __init__(self, tree: Tree, ids, labels, rows, anchors: np.ndarray, anchor_labels, anchor_rows, low: np.ndarray, high: np.ndarray, k: int, negative: bool):
        order = tree.order
        self.tree, self.ids, self.labels, self.rows = tree, ids[order], labels[order], rows[order]
        self.anchors, self.anchor_labels, self.anchor_rows = anchors, anchor_labels, anchor_rows
        self.ends = low, high
        self.low, self.high = np.where(low == LOW, -np.inf, low), np.where(high == HIGH, np.inf, high)
        self.k, self.negative = k, negative
        shape = (*low.shape, k)
        self.best, self.best_at = np.full(shape, -np.inf), np.full(shape, -1, np.int64)
        self.norm = np.sqrt(np.einsum("ij,ij->i", anchors, anchors))
        self.seen = 0
        top = float(np.abs(anchors).max(initial=0)) * float(np.abs(tree.points).max(initial=0)) * max(1, anchors.shape[1])
        self.exact = top < EXACT
        if self.exact:
            self._visit(0, np.arange(len(anchors)))
        else:
            self._all()

    def _wanted(self, node: int, at: np.ndarray) -> np.ndarray:
        """Of the anchors at, those with a window that the node's ball may meet."""
        _, _, centre, radius, _ = self.tree.nodes[node]
        middle, reach = self.anchors[at] @ centre, self.norm[at] * radius
        slack = 1e-9 * (np.abs(middle) + reach) + 1e-6
        upper, lower = (middle + reach + slack)[:, None], (middle - reach - slack)[:, None]
        floor = np.maximum(self.low[at], self.best[at, :, -1])  # strictly beneath the kth, or below the window
        return at[((upper >= floor) & (lower <= self.high[at])).any(axis=1)]

    def _visit(self, root: int, at: np.ndarray) -> None:
        stack = [(root, at)]
        while stack:
            node, at = stack.pop()
            at = self._wanted(node, at)  # asked when its turn comes, as kth scores have risen since
            if not len(at):
                continue
            a, b, _, _, children = self.tree.nodes[node]
            if children:
                mean = self.anchors[at].mean(axis=0)
                near = sorted(children, key=lambda c: float(mean @ self.tree.nodes[c][2]))
                stack += [(c, at) for c in near]
            else:
                for s in range(a, b, 4 * LEAF):  # a leaf of equal rows may be long
                    self._leaf(at, s, min(b, s + 4 * LEAF))

    def _allowed(self, at: np.ndarray, a: int, b: int) -> np.ndarray:
        same = self.anchor_labels[at][:, None] == self.labels[a:b][None, :]
        return ~same if self.negative else same & (self.anchor_rows[at][:, None] != self.rows[a:b][None, :])

    def _leaf(self, at: np.ndarray, a: int, b: int) -> None:
        self.seen += len(at) * (b - a)
        scores = self.anchors[at] @ self.tree.points[a:b].T
        allowed = self._allowed(at, a, b)
        for w in range(self.low.shape[1]):
            hit = allowed & (scores >= np.maximum(self.low[at, w], self.best[at, w, -1])[:, None]) & (scores <= self.high[at, w][:, None])
            i, j = np.nonzero(hit)
            if len(i):
                self._merge(at, w, i, scores[i, j], a + j)

    def _merge(self, at: np.ndarray, w: int, i: np.ndarray, score: np.ndarray, place: np.ndarray) -> None:
        some = np.unique(i)
        k = self.k
        who = np.concatenate([i, np.repeat(some, k)])
        score = np.concatenate([score, self.best[at[some], w].ravel()])
        place = np.concatenate([place, self.best_at[at[some], w].ravel()])
        held = place >= 0
        who, score, place = who[held], score[held], place[held]
        order = np.lexsort((self.rows[place], self.ids[place], -score, who))
        who, score, place = who[order], score[order], place[order]
        first = np.flatnonzero(np.diff(who, prepend=-1))
        rank = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
        top = rank < k
        self.best[at[who[top]], w, rank[top]] = score[top]
        self.best_at[at[who[top]], w, rank[top]] = place[top]

    def _all(self) -> None:
        """Numbers too large for doubles: every row, by Python's integers; best holds the scores as longs."""
        points = [[int(x) for x in p] for p in self.tree.points]
        self.long = np.zeros(self.best.shape, np.int64)
        for q, anchor in enumerate(self.anchors):
            anchor = [int(x) for x in anchor]
            allowed = self._allowed(np.array([q]), 0, len(points))[0]
            scores = [(min(HIGH, max(LOW, sum(x * y for x, y in zip(anchor, p, strict=True)))), j) for j, p in enumerate(points) if allowed[j]]
            for w in range(self.low.shape[1]):
                found = sorted(((-s, int(self.ids[j]), int(self.rows[j]), j) for s, j in scores if self.ends[0][q, w] <= s <= self.ends[1][q, w]))[: self.k]
                for r, (s, _, _, j) in enumerate(found):
                    self.long[q, w, r], self.best_at[q, w, r] = -s, j

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """anchor number, window number, score, place in the tree's order."""
        q, w, r = np.nonzero(self.best_at >= 0)
        score = self.best[q, w, r].astype(np.int64) if self.exact else self.long[q, w, r]
        return q, w, score, self.best_at[q, w, r]


def _blob(array: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(array, kind).tobytes()


def _packed(rows: DataFrame, by: list[str], most: int, windows: bool = False) -> DataFrame:
    """Rows sorted by `by` as blobs of one value of by[:-1] each, at most so many rows: by, n, d, ids, labels, rows, vectors (and low, high)."""
    columns = [("ids", "id"), ("labels", "label"), ("rows", "row")]

    def run(batches):
        kept: list[pa.Table] = []

        def out(t: pa.Table):
            vector = t.column("vector").combine_chunks()
            wide = [pa.array([_blob(t.column(c).combine_chunks().flatten().to_numpy(), "<i8")], pa.binary()) for c in ("low", "high")] if windows else []
            ids = t.column("id").fill_null(NULL_ID)
            longs = [pa.array([_blob(c.to_numpy(), "<i8")], pa.binary()) for c in (ids, t.column("label"), t.column("row"))]
            n = t.num_rows
            return pa.record_batch([*[pa.array([t.column(b)[0].as_py()], pa.int64()) for b in by], pa.array([n], pa.int64()), pa.array([len(vector.flatten()) // n], pa.int64()), *longs, pa.array([_blob(vector.flatten().to_numpy(), "<f8")], pa.binary()), *wide], [*by, "n", "d", *[c for c, _ in columns], "vectors", *(["low", "high"] if windows else [])])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            if kept:
                t = pa.concat_tables([*kept, t])
            key = np.stack([t.column(b).to_numpy() for b in by])
            cuts = [0, *(np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1).tolist(), t.num_rows]
            for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
                for s in range(a, b, most):
                    yield out(t.slice(s, min(most, b - s)))
            a = cuts[-2]
            while t.num_rows - a > most:
                yield out(t.slice(a, most))
                a += most
            kept = [t.slice(a)]
        if kept:
            yield out(kept[0])

    return rows.mapInArrow(run, ", ".join([*[f"{b} long" for b in by], "n long", "d long", *[f"{c} binary" for c, _ in columns], "vectors binary", *(["low binary", "high binary"] if windows else [])]))


def _cells(trees: DataFrame, blocks: DataFrame, n_trees: int, n_groups: int) -> DataFrame:
    """Each tree once for each group of blocks, each block once for each tree: sorted by cell, trees first."""
    own = trees.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_groups - 1))))).withColumn("kind", F.lit(0)).withColumn("low", F.lit(None).cast("binary")).withColumn("high", F.lit(None).cast("binary"))
    met = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_trees - 1))))).withColumn("kind", F.lit(1))
    names = ["part", "grp", "kind", "n", "d", "ids", "labels", "rows", "vectors", "low", "high"]
    both = own.select(*names).unionByName(met.select(*names))
    tasks = max(1, min(MOST_TASKS, n_trees * n_groups))
    return both.repartition(tasks, "part", "grp").sortWithinPartitions("part", "grp", "kind")


def _searched(k: int, negative: bool, leaf: int):
    def run(batches):
        key, trees = None, {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                n, d = row["n"], row["d"]
                ids, labels, rows = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels", "rows"))
                matrix = np.frombuffer(row["vectors"], "<f8").reshape(n, d)
                if (row["part"], row["grp"]) != key:
                    key, trees = (row["part"], row["grp"]), {}
                if row["kind"] == 0:
                    trees.setdefault(d, []).append((Tree(matrix, leaf), ids, labels, rows))
                    continue
                low, high = (np.frombuffer(row[c], "<i8").reshape(n, -1) for c in ("low", "high"))
                for tree, own_ids, own_labels, own_rows in trees.get(d, ()):
                    s = Search(tree, own_ids, own_labels, own_rows, matrix, labels, rows, low, high, k, negative)
                    q, w, score, place = s.found()
                    yield pa.record_batch({"anchor": pa.array(rows[q]), "slot": pa.array(w.astype(np.int64)), "score": pa.array(score), "id": pa.array(s.ids[place], mask=s.ids[place] == NULL_ID), "row": pa.array(s.rows[place])})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and slot, with their rank from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(trees: DataFrame, asked: DataFrame, k: int, negative: bool, n_trees: int, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """anchor (its row), slot, score, id, row, rank: the k best rows in each window of each row of asked (row, id, label, vector, low, high: arrays of longs)."""
    groups = max(1, math.ceil(asked.count() / block))
    dealt = asked.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long")).withColumn("len", F.size("vector").cast("long"))
    blocks = _packed(dealt.repartition(min(MOST_TASKS, groups), "grp").sortWithinPartitions("grp", "len"), ["grp", "len"], block, windows=True)
    cells = _cells(trees, blocks.drop("len"), n_trees, groups)
    return _best(cells.mapInArrow(_searched(k, negative, leaf), "anchor long, slot long, score long, id long, row long"), k)


def hard_negatives(df: DataFrame, anchors: Column | str, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST_PERCENT, most: int = MOST_PERCENT, scale: int = SCALE, block: int = BLOCK, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors: a condition on id."""
    condition = F.expr(anchors) if isinstance(anchors, str) else anchors
    rows = checkpointed(vectors(df, id_col, vector_col, label_col, scale))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("vector") * 8 + 24), F.lit(0))).first()
    shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_trees = max(1, math.ceil(size / tree_bytes), min(shuffles, math.ceil(n / LEAST_ROWS)))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(n_trees)).cast("long")).withColumn("len", F.size("vector").cast("long"))
    trees = checkpointed(_packed(dealt.repartition(min(MOST_TASKS, n_trees), "part").sortWithinPartitions("part", "len"), ["part", "len"], 1 << 20).drop("len"))
    asked = rows.where(condition)
    wide = lambda values: F.array(*values).cast("array<bigint>")
    first = asked.withColumns({"low": wide([F.lit(LOW)]), "high": wide([F.lit(HIGH)])})
    found = checkpointed(search(trees, first, positives, False, n_trees, block).select("anchor", "score", F.col("id").alias("positive_id"), "rank"))
    # A window for each positive; -1 to -2 is empty, for anchors with fewer.
    scores = found.groupBy(F.col("anchor").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("rank", "score"))).alias("scores"))
    exact = lambda p: F.col("scores")[F.lit(p + 1)].cast("decimal(38,0)")
    low = [F.coalesce(F.ceil(exact(p) * least / 100).cast("long"), F.lit(-1).cast("long")) for p in range(positives)]
    high = [F.coalesce(F.floor(exact(p) * most / 100).cast("long"), F.lit(-2).cast("long")) for p in range(positives)]
    second = asked.join(scores, "row").withColumns({"low": wide(low), "high": wide(high)}).drop("scores")
    mined = search(trees, second, negatives, True, n_trees, block).select("anchor", (F.col("slot") + 1).cast("int").alias("of"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = found.select(F.col("anchor"), F.col("rank").alias("of"), "positive_id", F.col("score").alias("positive_score"))
    ids = asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return mined.join(named, ["anchor", "of"]).join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END").alias("label"))
    return hard_negatives(rows, "id % 50 = 0")


ORACLE = """
WITH whole AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
        CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM whole a JOIN whole b ON a.vec_id % 50 = 0 AND len(a.v) = len(b.v)
), positive AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored
    WHERE same AND anchor_id <> other_id
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
    SELECT p.anchor_id, p.positive_id, n.other_id AS negative_id, p.positive_score, n.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS rank
    FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
        AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
) WHERE rank <= 3
"""
