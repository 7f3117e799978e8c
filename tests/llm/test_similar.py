"""The near-duplicate stage against brute force over all pairs."""

import numpy as np
import pyarrow as pa
import xxhash

import corpus_pipeline
from filegrain.llm import op10_similar


def brute_shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_kept(rows):
    """Places of rows (id, text) that stay."""
    sets = [brute_shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if root[i] != root[j] and 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                root = [root[j] if r == root[i] else r for r in root]
    best = {}
    for i, r in enumerate(root):
        best[r] = min(best.get(r, i), i, key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    return sorted(best.values())


def test_stage_finds_all_near_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, None).select("doc_id").collect()}
    assert got == {rows[k][0] for k in brute_kept(rows)}


def test_null_and_repeated_ids(spark):
    words = [f"w{k}" for k in range(60)]
    text, close, other = " ".join(words), " ".join([*words[:-1], "end"]), " ".join(reversed(words))
    docs = spark.createDataFrame([(1, text), (2, close), (2, other), (None, close), (None, "alone"), (3, "alone"), (4, "twice"), (4, "twice")], "doc_id long, text string")
    assert sorted(map(tuple, op10_similar.one_of_each(docs).collect())) == [(1, text), (2, other), (3, "alone"), (4, "twice")]


def test_groups_in_one_bucket():
    r = np.random.default_rng(3)
    base = [set(r.integers(0, 10**9, 100).tolist()) for _ in range(3)]
    sets = [sorted(set(r.choice(sorted(base[k % 3]), 92, replace=False).tolist()) | set(r.integers(0, 10**9, 4).tolist())) for k in range(40)]
    links = op10_similar.similar_pairs(pa.array(sets, pa.list_(pa.int64())), np.arange(40), 0.8)
    root = list(range(40))
    for a, b in links:
        assert 5 * len(set(sets[a]) & set(sets[b])) >= 4 * len(set(sets[a]) | set(sets[b]))
        root = [root[a] if x == root[b] else x for x in root]
    want = list(range(40))
    for i in range(40):
        for j in range(i):
            if 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j])):
                want = [want[j] if x == want[i] else x for x in want]
    assert len(set(root)) == len(set(want)) and len(set(zip(root, want, strict=True))) == len(set(want))


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 2]), 42) for i in range(max(1, len(words) - 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_join_all_texts_within_three_bits(spark):
    """The stage's own SimHash step joins texts as all pairs within 3 bits do, and what of it is similar ends in one group."""
    said = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(400).collect()]
    said += [t.rsplit(" ", 1)[0] for t in said[:60]]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    rows = op10_similar._rows(docs, "doc_id", "text")
    text = {r["node"]: r["text"] for r in rows.collect()}
    nodes = sorted(text)
    place = {n: i for i, n in enumerate(nodes)}
    sets, prints = [brute_shingles(text[n]) for n in nodes], [brute_print(text[n]) for n in nodes]
    want, got = list(range(len(nodes))), list(range(len(nodes)))
    for i in range(len(nodes)):
        for j in range(i):
            if want[i] != want[j] and (prints[i] ^ prints[j]).bit_count() <= 3:
                want = [want[j] if x == want[i] else x for x in want]
    links = [(place[r["a"]], place[r["b"]]) for r in op10_similar.close_pairs(op10_similar._sketches(rows, 5)).collect()]
    for i, j in links:
        got = [got[j] if x == got[i] else x for x in got]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want)) < len(nodes) - 30
    root = {r["node"]: r["root"] for r in op10_similar.groups(docs)[1].collect()}
    similar = [(i, j) for i, j in links if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert similar and all(root.get(nodes[i], nodes[i]) == root.get(nodes[j], nodes[j]) for i, j in similar)


def test_pairs_that_fingerprints_joined_are_not_open(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 5)], "a long, b long")
    joined = spark.createDataFrame([(1, 2), (1, 3), (1, 5)], "a long, b long")
    assert sorted(map(tuple, op10_similar._open(pairs, op10_similar._labels(joined)).collect())) == [(1, 4), (4, 5)]
