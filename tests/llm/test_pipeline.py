"""The pipeline's stages against brute force, each on what its predecessor kept."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from filegrain.llm import op4_line_dedup, op7_quality, op9_mixing

from .test_operators import brute_quality
from .test_similar import brute_kept as near_kept

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf_dir = "/root/testdata/sf0.001"
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [("input", docs)]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        out.append((name, docs))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def distance(p, q):
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.sqrt(sum(np.where(x > 0, x * np.log2(x / m), 0).sum() for x in (p, q)) / 2)


def test_columns_stay(stages):
    assert [n for n, _ in stages[1:]] == ["quality", "lines", "near_duplicates", "mixing", "tokens"]
    for _, df in stages[:-1]:
        assert df.columns == COLUMNS


def brute_kept(text, lang):
    """Does a document pass the quality rules? lang has a reference."""
    n, _, _, _, repeats = brute_quality(text)
    chars = np.array(op7_quality.measure([text])["chars"][0], float)
    words = Counter(w.decode() for w in (text or "").encode().lower().split())
    own = np.array([words[w] for w in op7_quality.COMMON[lang]], float) / max(n, 1)
    of_chars, of_words = map(np.array, op7_quality.REFERENCES[lang])
    none = np.zeros(len(of_words))
    none[-1] = 1
    d_chars = distance(chars / max(1, chars.sum()), of_chars)
    d_words = distance(np.append(own, max(0, 1 - own.sum())), of_words) / distance(none, of_words)
    above = lambda d, limit: d > max(limit[0] / np.sqrt(n), limit[1])
    if n < 10 or 100 * repeats > 20 * n:
        return False
    return n < op7_quality.MIN_WORDS or not (above(d_chars, op7_quality.ALONE) or above(d_chars, op7_quality.BOTH_CHARS) and above(d_words, op7_quality.BOTH_WORDS))


def test_quality(stages):
    before, after = rows(stages[0][1]), rows(stages[1][1])
    kept = {i for i, r in before.items() if brute_kept(r["text"], r["lang"])}
    assert set(after) == kept and 0 < len(kept) < len(before)
    assert all(after[i] == before[i] for i in kept)


def test_lines(stages):
    before, after = rows(stages[1][1]), rows(stages[2][1])
    strip = lambda x: x.strip(" \t\n\r\x0b\x0c")
    pages, found = Counter(), Counter()
    for r in before.values():
        pages[r["source"]] += 1
        found.update((r["source"], x) for x in {strip(x) for x in r["text"].split("\n")} if x)
    common = {k for k, n in found.items() if n >= op4_line_dedup.MIN_PAGES and n > op4_line_dedup.SOURCE_RATIO * pages[k[0]]}
    assert set(after) == set(before)
    for i, r in before.items():
        want = "\n".join(x for x in r["text"].split("\n") if (r["source"], strip(x)) not in common)
        assert after[i]["text"] == want and after[i]["n_chars"] == len(want)


def test_near_duplicates(stages):
    """One document of each group stays: five-word shingles, a similarity of 0.8."""
    before, after = rows(stages[2][1]), rows(stages[3][1])
    ids = sorted(before)
    kept = near_kept([(i, before[i]["text"]) for i in ids])
    assert set(after) == {ids[k] for k in kept} and len(after) < len(before)
    assert all(after[i] == before[i] for i in after)


def test_mixing(stages):
    before = rows(stages[3][1])
    assert rows(stages[4][1]) == before
    files = sorted(f.removeprefix("file://") for f in stages[4][1].inputFiles())
    after = [i for f in files for i in pq.read_table(f)["doc_id"].to_pylist()]  # the files in order, each in order
    mix = op9_mixing.mixed(stages[3][1], op9_mixing.SHARES)
    slot = {r["doc_id"]: (r["fg_slot"], r["fg_key"]) for r in mix.collect()}
    assert [slot[i] for i in after] == sorted(slot.values())


def test_tokens(stages):
    import base64
    import hashlib

    import public_tokenizers
    import tiktoken

    from filegrain.llm.op5_byte_bpe import default_ranks

    with open(default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before, after = rows(stages[4][1]), rows(stages[5][1])
    assert set(after) == set(before)
    for i, r in after.items():
        assert r["ids"] == library.encode_ordinary(before[i]["text"]) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(before[i]["text"].encode()).hexdigest()


def test_hard_and_empty_documents(spark, hard, empty):
    for docs in (hard, empty):
        df, n = docs, docs.count()
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, None)
            if k < 4:
                assert out.columns == docs.columns
                assert defaultdict(int)[""] <= out.count() <= n
            df = out if k < 4 else df
        assert out.count() == df.count()


def test_each_stage_gets_hard_rows(spark, hard):
    """Nulls, empty texts, repeats and names that differ in case alone, before each stage."""
    docs = hard.withColumnsRenamed({"part": "Text", "key": "DOC_ID"})
    want = Counter(tuple(r) for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, None).collect()
        got = Counter(tuple(r) for r in made) if name != "tokens" else {}
        if name == "quality":
            place = docs.columns.index("text"), docs.columns.index("lang")
            known = {r: n for r, n in want.items() if r[place[1]] in op7_quality.COMMON}
            assert {r: n for r, n in got.items() if r in known} == {r: n for r, n in known.items() if brute_kept(r[place[0]], r[place[1]])}
            assert not [r for r in got if not r[place[0]]]
        elif name == "near_duplicates":
            texts = [(r[0], r[1]) for r in sorted(want, key=lambda r: (r[0] is None, r[0] or 0))]
            assert Counter(r[1] or "" for r in got.elements()) == Counter(texts[k][1] or "" for k in near_kept(texts))
        elif name == "mixing":
            assert got == want
        elif name == "lines":
            assert sum(got.values()) == sum(want.values())
        else:
            assert len(made) == sum(want.values()) and all(r["n_tokens"] == len(r["ids"]) for r in made)


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
