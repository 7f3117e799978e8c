"""Quality rules: base counts, and the Jensen-Shannon distance to references of each language.

A document has two histograms: of character classes, and of the common words of its language (with all other
words as one class). REFERENCES holds the same shares for each language: means over labelled good documents, made once
by fit() from a bounded labelled sample. They are fixed then, so a verdict depends on the document alone. A document is
rejected if its distance of classes exceeds a limit, or if both distances exceed lower limits (that of words as a share
of the distance that a text without any common word has). The fewer words, the wider a histogram scatters, so limits
are scale / sqrt(words), but never below a floor. Below MIN_WORDS, where a histogram says nothing, only the base rules
hold. A document whose language has no reference (null or unknown) is compared with the nearest one.

References and limits are from the labelled documents of the 0.1 tables whose id's MD5 begins with an even byte; of the
others, which nothing was fitted on, README has the figures.

Defined results: null text has no words and fails the base rules. Null ids stay null; rows that repeat an id or a text
are judged each. A distance at a limit is kept. Very long texts are counted whole. An empty table gives an empty one.
Other columns of docs, whatever their names, are not read, and kept_rows() returns them as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import at, named, numbered, pick, pieces, table

#: Common words by language. Fixed values.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in is that for it was on are as with his they at be this have".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "fr": "de la le et les des en un du une que est pour qui dans sur pas au par avec".split(),
}
LANGS = sorted(COMMON)
VOCABULARY = sorted({w for ws in COMMON.values() for w in ws})
CLASSES = ("lower", "upper", "digit", "space", "point", "symbol", "other", "letter")  # letter: beyond ASCII
MIN_WORDS = 20
#: Scale and floor of limits: of classes alone; of classes and of words together.
ALONE, BOTH_CHARS, BOTH_WORDS = (2.6, 0.12), (1.8, 0.1), (7.0, 0.4)
#: Labelled documents that fit() reads at most.
LABELLED = 20_000
#: By language: shares of CLASSES, and of the words of COMMON with all others at the end. Fitted values.
REFERENCES = {
    "de": ([0.7716, 0.0126, 0.001, 0.1542, 0.0223, 0.0, 0.0, 0.0381], [0.0548, 0.0292, 0.0225, 0.0168, 0.0143, 0.0109, 0.0095, 0.0098, 0.008, 0.0077, 0.0065, 0.0068, 0.0056, 0.0049, 0.005, 0.0046, 0.0044, 0.0046, 0.0049, 0.0034, 0.7658]),
    "en": ([0.794, 0.0144, 0.001, 0.1664, 0.0242, 0.0, 0.0, 0.0], [0.0557, 0.0286, 0.024, 0.0169, 0.0118, 0.0106, 0.0093, 0.0077, 0.0082, 0.0067, 0.0068, 0.0044, 0.0055, 0.0057, 0.0, 0.0, 0.0043, 0.0047, 0.0045, 0.0, 0.7848]),
    "es": ([0.7215, 0.0131, 0.0011, 0.1612, 0.0242, 0.0, 0.0, 0.0789], [0.0552, 0.0273, 0.0225, 0.0153, 0.014, 0.0108, 0.0, 0.0097, 0.0088, 0.0068, 0.0098, 0.0066, 0.0072, 0.006, 0.0052, 0.0046, 0.0051, 0.0049, 0.0039, 0.0043, 0.7721]),
    "fr": ([0.7057, 0.0111, 0.0021, 0.1662, 0.0246, 0.0, 0.0001, 0.0902], [0.0553, 0.0294, 0.0221, 0.0154, 0.0136, 0.013, 0.0109, 0.0097, 0.0088, 0.007, 0.0068, 0.0066, 0.0059, 0.0051, 0.0048, 0.0043, 0.004, 0.0042, 0.0041, 0.0039, 0.7652]),
}
WINDOW = 5
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<long>, common array<long>"


def _class_table() -> np.ndarray:
    """The class of each byte of UTF-8 that starts a character; 8 for those that go on with one."""
    out = np.full(256, 6, np.uint8)
    for kind, chars in ((0, b"abcdefghijklmnopqrstuvwxyz"), (1, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, b"0123456789"), (3, b" \t\n\r\x0b\x0c"), (4, b".,;:!?'\"()-"), (5, b"#*$%&|<>")):
        out[list(chars)] = kind
    out[0x80:0xC0] = 8
    out[0xC0:] = 7
    return out


CLASS_OF = _class_table()
MULTIPLIERS = np.random.default_rng(5).integers(0, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
NUMBER = {w.encode(): i for i, w in enumerate(VOCABULARY)}


def measure(texts: list[str | None]) -> dict[str, list]:
    """The base counts and both histograms (common words by place in VOCABULARY) of texts."""
    raw = [(t or "").encode() for t in texts]
    split = [b.split() for b in raw]
    n_words = np.array([len(w) for w in split], np.int64)
    chars = np.array([np.bincount(CLASS_OF[np.frombuffer(b, np.uint8)], minlength=9)[:8] for b in raw], np.int64).reshape(-1, 8)
    total = int(n_words.sum())
    hashed = np.fromiter((hash(w) for ws in split for w in ws), np.int64, total).view(np.uint64)
    doc = np.repeat(np.arange(len(raw)), n_words)
    repeat = np.zeros(len(raw), np.int64)
    if total >= WINDOW:
        at = np.flatnonzero(doc[: total - WINDOW + 1] == doc[WINDOW - 1 :])
        h = doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(WINDOW):
            h += hashed[at + k] * MULTIPLIERS[k]
        _, index, counts = np.unique(h ^ (h >> np.uint64(31)), return_inverse=True, return_counts=True)
        edges = np.zeros(total + 1, np.int64)
        found = at[counts[index] > 1]
        np.add.at(edges, found, 1)
        np.add.at(edges, found + WINDOW, -1)
        repeat = np.bincount(doc[np.cumsum(edges[:-1]) > 0], minlength=len(raw))
    dup_lines, common = [], np.zeros((len(raw), len(VOCABULARY)), np.int64)
    for i, (b, ws) in enumerate(zip(raw, split, strict=True)):
        lines = [x for x in b.split(b"\n") if x.strip()]
        dup_lines.append(len(lines) - len(set(lines)))
        known = [NUMBER[w] for w in b.lower().split() if w in NUMBER] if ws else []
        if known:
            common[i] = np.bincount(known, minlength=len(VOCABULARY))
    return {"n_words": n_words, "word_chars": chars.sum(axis=1) - chars[:, 3], "n_symbols": chars[:, 5], "n_dup_lines": dup_lines, "n_repeat_words": repeat, "chars": chars.tolist(), "common": common.tolist()}


def stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang and MEASURES; a row for each row."""
    return _measured(pick(docs, doc_id=(id_col, "long"), lang=(lang_col, "string"), text=(text_col, "string")), "text").drop("text")


def _measured(rows: DataFrame, text: str) -> DataFrame:
    """rows with MEASURES of a column."""
    schema = StructType(rows.schema.fields + StructType.fromDDL(MEASURES).fields)

    def run(batches):
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for a, b in pieces({"text": texts}, most=1 << 20):
                m = measure(texts[a:b])
                longs = pa.list_(pa.int64())
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array(v, longs if k in ("chars", "common") else pa.int64()) for k, v in m.items()]], [*own.schema.names, *m])

    return rows.mapInArrow(run, schema)


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> dict[str, tuple[list[float], list[float]]]:
    """References from labelled documents: docs (doc_id, text, lang), labels (doc_id, quality: 1 is good), of which at most so many are read, in the order of a hash of the id."""
    good = pick(labels, doc_id=("doc_id", "long"), quality=("quality", "int")).where("quality = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(most)
    rows = pick(docs, doc_id=("doc_id", "long"), lang=("lang", "string"), text=("text", "string")).join(F.broadcast(good), "doc_id")
    measured = stats(rows)
    words_ = F.greatest(F.col("n_words"), F.lit(1))
    letters = F.greatest(F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1))
    used = measured.where(F.col("lang").isin(LANGS) & ~base_failed() & (F.col("n_words") >= 50))
    shares = used.select("lang", F.posexplode(F.concat(F.transform("chars", lambda x: x / letters), F.transform("common", lambda x: x / words_))).alias("i", "share"))
    means: dict[str, dict[int, float]] = {}
    for lang, i, mean in shares.groupBy("lang", "i").agg(F.avg("share")).collect():  # a row for each language and class
        means.setdefault(lang, {})[i] = float(mean)
    out = {}
    for lang, by_place in means.items():
        own = [by_place[len(CLASSES) + VOCABULARY.index(w)] for w in COMMON[lang]]
        out[lang] = [by_place[i] for i in range(len(CLASSES))], [*own, max(0.0, 1 - sum(own))]
    return out


def _distance(shares, reference):
    """Jensen-Shannon distance (base 2, 0 to 1) of two array columns of shares."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(shares, reference, lambda p, q: term(p, (p + q) / 2) + term(q, (p + q) / 2))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def _wordless(reference: list[float]) -> float:
    """The distance of a text without common words from a language's shares."""
    p, q = np.array([0.0] * (len(reference) - 1) + [1.0]), np.array(reference)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(x > 0, x * np.log2(x / m), 0.0).sum() for x in (p, q)]
    return float(np.sqrt(max(0.0, sum(parts) / 2)))


def _above(distance, limit: tuple[float, float]):
    scale, floor = limit
    return distance > F.greatest(F.lit(scale) / F.sqrt(F.col("n_words")), F.lit(floor))


def _verdict(measured: DataFrame, references: dict) -> DataFrame:
    """measured (lang, MEASURES) with base_failed, js_chars, js_words, kept."""
    # One bounded constant for each language; arrays keep the compiled code small.
    known = F.array(*(F.struct(F.lit(lang).alias("lang"), F.lit([VOCABULARY.index(w) for w in COMMON[lang]]).alias("at"), F.lit(a).alias("chars"), F.lit(b).alias("words"), F.lit(max(_wordless(b), 1e-9)).alias("wordless")) for lang, (a, b) in references.items()))
    letters = F.greatest(F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1))
    out = measured.withColumn("known", F.when(F.col("lang").isin(list(references)), F.filter(known, lambda r: r["lang"] == F.col("lang"))).otherwise(known))
    out = out.withColumn("class_shares", F.transform("chars", lambda x: x / letters))

    def own(r):
        shares = F.transform(r["at"], lambda i: F.get("common", i) / F.greatest("n_words", F.lit(1)))
        return F.concat(shares, F.array(F.greatest(1 - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))))

    chars = F.array_min(F.transform("known", lambda r: _distance(F.col("class_shares"), r["chars"])))
    words_ = F.array_min(F.transform("known", lambda r: _distance(own(r), r["words"]) / r["wordless"]))
    out = out.withColumn("base_failed", base_failed()).withColumn("js_chars", chars).withColumn("js_words", words_)
    far = (F.col("n_words") >= MIN_WORDS) & (_above(F.col("js_chars"), ALONE) | (_above(F.col("js_chars"), BOTH_CHARS) & _above(F.col("js_words"), BOTH_WORDS)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", references: dict | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, js_chars, js_words (as a share of a wordless text's), kept. A row for each row."""
    out = _verdict(stats(docs, id_col, text_col, lang_col), references or REFERENCES)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_chars", "js_words", "kept")


def kept_rows(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", references: dict | None = None) -> DataFrame:
    """The rows of docs that the rules keep, in one pass over them."""
    lang = F.col(at(docs, lang_col)).cast("string")
    rows = _measured(numbered(docs).withColumn("lang", lang).withColumn("judged_text", F.col(at(docs, text_col)).cast("string")), "judged_text")
    return named(docs, _verdict(rows, references or REFERENCES).where("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))
