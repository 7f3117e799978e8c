"""The Jaccard join against brute force over all pairs."""

import numpy as np
import pytest

from filegrain.llm import op13_jaccard_join as op13


def brute(rows, size=4, percent=85):
    """(id, n, component) of rows (id, text)."""
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and root[i] != root[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root = [root[j] if r == root[i] else r for r in root]
    least = {r: min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None), default=None) for r in set(root)}
    return sorted(((i, len(s), least[r] if s else i) for (i, _), s, r in zip(rows, sets, root, strict=True)), key=str)


def got(spark, rows, **more):
    return sorted((tuple(r) for r in op13.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **more).collect()), key=str)


def family(r, n, words=120, edits=9, first=0):
    """Near copies of one text, some of them far from each other."""
    base = [f"b{first}-{k}" for k in range(words)]
    out = []
    for k in range(n):
        text = list(base)
        for e in r.integers(0, words, int(r.integers(0, edits))).tolist():
            text[e] = f"e{first}-{k}-{e}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("cell", [(2048, 2 << 20), (6, 700)])
def test_families_copies_and_short_texts(spark, monkeypatch, cell):
    monkeypatch.setattr(op13, "CELL_ROWS", cell[0])
    monkeypatch.setattr(op13, "CELL_TOKENS", cell[1])
    r = np.random.default_rng(8)
    texts = [*family(r, 40), *family(r, 25, 60, 4, 1), *family(r, 30, 200, 12, 2)]
    passage = " ".join(f"p{k}" for k in range(50))
    texts += [f"{passage} {' '.join(f'u{k}-{j}' for j in range(int(r.integers(1, 30))))}" for k in range(40)]
    texts += [texts[0], texts[0].upper(), texts[0].replace(" ", "\n"), None, "", " \t", "one", "ONE", "one two three", "one  two three", "a b c d", "a b c d e", "É é", "é é"]
    rows = [(k, t) for k, t in enumerate(texts)]
    want = brute(rows)
    assert got(spark, rows) == want
    assert 60 < len({c for _, _, c in want}) < 140


def test_null_and_repeated_ids(spark):
    words = " ".join(f"w{k}" for k in range(50))
    rows = [(5, words), (5, words), (5, "other words than these are here"), (None, words), (None, "alone in this"), (None, "alone  in this"), (3, words + " more"), (None, None), (None, None)]
    assert got(spark, rows) == brute(rows)


def test_an_empty_table_and_names_that_clash(spark, empty):
    assert op13.jaccard_components(empty).count() == 0
    df = spark.createDataFrame([(1, "a b c d e", 2, "x"), (2, "a  b c d e", 2, "y")], "Doc long, body string, node int, digest string")
    assert sorted(map(tuple, op13.jaccard_components(df, "Doc", "body").collect())) == [(1, 2, 1), (2, 2, 1)]


def test_query_on_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    want = brute(rows)
    assert sorted((tuple(r) for r in op13.query(spark, str(tmp_path)).collect()), key=str) == want
    assert len({c for _, _, c in want}) < len(rows)


@pytest.mark.parametrize("seed", range(6))
def test_trie(seed):
    r = np.random.default_rng(seed)
    base = [np.unique(r.integers(0, 400, 60)) for _ in range(3)]
    sets = [np.unique(np.concatenate([r.permutation(base[k % 3])[: int(r.integers(40, 60))], r.integers(400, 420, int(r.integers(0, 5)))])) for k in range(80)] + [np.array([3]), np.array([3]), np.array([3, 4])]
    group = np.arange(len(sets))
    group[5] = 8
    root = group.copy()
    for i in range(len(sets)):
        for j in range(i):
            if op13.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 70):
                root[root == root[i]] = root[j]
    mine = group.copy()
    for i, j in op13.trie_links(sets, group, 70):
        assert op13.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 70)
        mine[mine == mine[i]] = mine[j]
    assert len(set(zip(root.tolist(), mine.tolist(), strict=True))) == len(set(root.tolist())) == len(set(mine.tolist()))
