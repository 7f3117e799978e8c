"""Hard negatives against SQL and a brute-force version."""

import math

import duckdb
import numpy as np
import pytest

from filegrain.llm import op11_hard_negatives as op11

SCHEMA = "vec_id long, embedding array<double>, label int, row string, score long"


def brute(rows, anchor, positives=5, negatives=3):
    """rows: (id, vector, label); any row counts once for each time that it is there."""
    whole = [(i, [math.floor(256 * x) for x in v], lab, k) for k, (i, v, lab) in enumerate(rows) if lab is not None and v is not None and all(x is not None and math.isfinite(256 * x) for x in v)]
    order = lambda c: (-c[0], c[1] is None, c[1] or 0)
    out = []
    for i, v, lab, k in whole:
        if i is None or not anchor(i):
            continue
        scored = [(max(op11.LOW, min(op11.HIGH, sum(x * y for x, y in zip(v, w, strict=True)))), j, other, n) for j, w, other, n in whole if len(w) == len(v)]
        for p in sorted((c for c in scored if c[2] == lab and c[3] != k), key=order)[:positives]:
            met = sorted((c for c in scored if c[2] != lab and 50 * p[0] <= 100 * c[0] <= 95 * p[0]), key=order)[:negatives]
            out += [(i, p[1], r + 1, c[1], p[0], c[0]) for r, c in enumerate(met)]
    return sorted(out, key=str)


def random_rows(seed, n, dims=6):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, dims))
    return [(int(i), (centres[r.integers(4)] + 0.2 * r.normal(size=dims)).round(2).tolist(), int(r.integers(3))) for i in range(n)]


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in op11.hard_negatives(df, "id % 5 = 0", **more).collect()), key=str)


@pytest.mark.parametrize(("tree_bytes", "block"), [(op11.TREE_BYTES, op11.BLOCK), (4_000, 7)])
def test_clusters_ties_and_repeats(spark, tree_bytes, block):
    rows = random_rows(5, 260)
    rows += [(i, rows[3][1], i % 2) for i in range(300, 380)]  # one vector in many rows: ties
    rows += [rows[10], rows[10], rows[15], (15, rows[16][1], 2), (None, rows[3][1], 0), (None, rows[3][1], 0)]
    rows += [(400, None, 1), (405, [1.0] * 6, None), (410, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (415, [float("nan")] * 6, 1), (420, [float("inf")] + [0.0] * 5, 1)]
    rows += [(425, [0.5, 0.5], 0), (426, [0.5, 0.6], 0), (427, [0.4, 0.4], 1), (430, [], 0), (431, [], 0), (432, [], 1)]
    got = mined(spark, rows, tree_bytes=tree_bytes, block=block)
    assert got == brute(rows, lambda i: i % 5 == 0)
    assert (430, 431, 1, 432, 0, 0) in got and any(r[0] == 425 for r in got)


def test_numbers_beyond_doubles(spark):
    rows = [(0, [1e9, 3e7], 0), (1, [1e9 + 0.25, 3e7], 0), (2, [0.9e9, 1.0], 1), (3, [0.9e9, 2.0], 1), (4, [3.0, 5.0], 1), (5, [1e18, 1e20], 0)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_an_empty_table_and_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.8], 0)]) == [(0, 1, 1, 2, 65536, 52224)]


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    want = sorted(con.execute(op11.ORACLE).fetchall())
    assert sorted(map(tuple, op11.query(spark, "/root/testdata/sf0.01").collect())) == want and len(want) > 100


def test_bounds_prune():
    """In tight clusters most of the tree is never compared."""
    r = np.random.default_rng(2)
    points = np.floor(256 * (np.repeat(r.normal(size=(64, 16)), 64, axis=0) + 0.01 * r.normal(size=(4096, 16))))
    ids = np.arange(len(points))
    tree = op11.Tree(points, 32)
    some = points[:40]
    one = np.full((40, 1), op11.LOW), np.full((40, 1), op11.HIGH)
    s = op11.Search(tree, ids, ids * 0, ids, some, ids[:40] * 0, ids[:40], *one, 5, False)
    q, _, score, place = s.found()
    for k in range(40):
        own = [(-int(points[j] @ points[k]), j) for j in ids if j != k]
        assert sorted(zip((-score[q == k]).tolist(), s.ids[place[q == k]].tolist(), strict=True)) == sorted(own)[:5]
    assert s.seen < 0.5 * 40 * len(points)
