"""Periodic runs against a brute-force version that tries each period."""

import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from filegrain.llm import op12_periodic_runs as op12

from .conftest import hard_rows


def brute_runs(items, least=6, times=4):
    n, out = len(items), []
    for p in range(1, n):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and items[i] == items[i + p]:
                i += 1
            length = i + p - start
            own = items[start : start + length]
            smaller = any(all(own[k] == own[k + q] for k in range(length - q)) for q in range(1, p))
            if i > start and length >= max(least, times * p, 2 * p) and not smaller:
                out.append((start, length, p))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], sha(listed.encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


@given(st.lists(st.integers(0, 2), max_size=40), st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(0, 9), st.sampled_from([(6, 4), (2, 2), (3, 3), (8, 5), (1, 1)]))
@settings(max_examples=300, deadline=None)
def test_runs(items, unit, times, limits):
    items = items[: len(items) // 2] + unit * times + items[len(items) // 2 :]
    assert op12.runs(items, *limits) == brute_runs(items, *limits)


def test_long_runs_take_time_in_proportion():
    for items, want in (([1] * 50_000, [(0, 50_000, 1)]), (list(range(1000)) * 60, [(0, 60_000, 1000)]), (list(range(60_000)), [])):
        assert op12.runs(items) == want


def some_texts():
    texts = [t if len(t or "") < 20_000 else t[:3_000] for _, t, *_ in hard_rows()]
    texts += ["a b c " * 7, "x y " + "a b " * 9 + "b " * 8 + "z", "q " * 6, "q " * 5, "ab ab ab ab", "a b a b a b a b", "  é " * 8]
    return [*texts, *(" ".join(f"w{(k * k + j) % 11}" for k in range(60)) for j in range(60))]


def test_query_matches_brute_force(spark, tmp_path):
    rows = list(enumerate(some_texts()))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in op12.query(spark, str(tmp_path)).collect()}
    assert got == {brute_row(*r) for r in rows}
    assert sum(r[1] > 0 for r in got) > 8


def test_null_ids_repeated_rows_and_empty_tables(spark, hard, empty):
    assert op12.periodic_runs(empty).count() == 0
    rows = op12.periodic_runs(hard).collect()
    assert len(rows) == hard.count()
    looped = spark.createDataFrame([(None, "a b " * 5), (1, "a b " * 5), (1, "a b " * 5), (2, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in op12.periodic_runs(looped).collect())
    assert got == [(0, 10, [(0, 10, 2)], "a b"), (1, 10, [(0, 10, 2)], "a b"), (1, 10, [(0, 10, 2)], "a b"), (2, 0, [], "")]
    assert op12.looped(looped).count() == 4


def test_names_that_clash(spark):
    docs = spark.createDataFrame([("k", 3, "a b " * 4, 1, "n")], "runs string, doc_id int, text string, H int, g string")
    assert [len(r["runs"]) for r in op12.periodic_runs(op12.looped(docs)).collect()] == [1]
