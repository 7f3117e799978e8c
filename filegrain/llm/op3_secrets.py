"""Secret scan: patterns, and character Markov models of random strings and ordinary identifiers.

Two first-order Markov models over characters are counted from labelled samples (token, secret): one of random
strings in seven alphabets, one of ordinary identifiers: names made of words, paths, dates, numbers, UUIDs, runs of
one character. A token of TOKEN characters is a secret if the logarithm of the models' likelihood ratio exceeds LEAST
for each of its character pairs on average. The ratio is a table of at most 128 x 128 numbers, which is the whole
model. The words are those of a public vocabulary (a parameter), so no text that is scanned shapes the model. Samples
are SAMPLES of either label; a hash puts each into the half that is trained on or the half that is held out, on which
recall and false alarms are measured. A deployment can train on its own labelled tokens.

All steps are DataFrame expressions. Positions come from the lengths of what stands between matches, summed in
blocks, so a text with very many matches costs in proportion to its length, however long it is.

Base spans, leftmost and non-overlapping for each kind: assign (a whole `name = value` match whose value has 8
characters), access (AKIA key), hex (32 digits). Spans of kind markov are added where no base span overlaps.
Defined results: null text is empty, and has no spans. Null ids stay null; rows that repeat an id or a text are rows
each. Spans that begin together are in the order of their kinds. An empty table gives an empty one. Other columns of
docs, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, place, table

NAMES = r"(?i:(password|passwd|secret|token|api_?key))"
ASSIGN = NAMES + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs that fail the length are maximal, so asking for the length finds the same spans.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST = 0.3
SAMPLES = 8000
SMOOTH = 0.5
BACK_OFF = 3
ALPHABET = 65
BLOCK = 256

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets of random strings.
ALPHABETS = (UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "-_", DIGITS + "abcdef", DIGITS + "ABCDEF", UPPER + "234567", DIGITS + LOWER)


def vocabulary(path: str | None = None) -> list[str]:
    """Words of three letters and more that begin a token of a public vocabulary (a file of ranks)."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        tokens = (base64.b64decode(line.split()[0]) for line in f)
        return [t[1:].decode() for t in tokens if re.fullmatch(rb" [A-Za-z]{3,}", t)]


def _random(d: bytes) -> tuple[str, int]:
    """A random string of 20 to 44 characters, and the number of its alphabet."""
    form = d[-1] % len(ALPHABETS)
    return "".join(ALPHABETS[form][x % len(ALPHABETS[form])] for x in d[: 20 + d[-2] % 25]), form


def _identifier(d: bytes, known: list[str]) -> tuple[str, int]:
    """An ordinary identifier, and how it is made."""
    one, *more = low = [known[int.from_bytes(d[4 * k : 4 * k + 4], "big") % len(known)].lower() for k in range(5)]
    title, h, number = [w.capitalize() for w in low], d.hex()[40:72], int.from_bytes(d[20:28], "big")
    uuid = f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"
    made = (
        "_".join(low),
        "-".join(low),
        one + "".join(title[1:]),
        "_".join(low).upper(),
        "".join(low),
        "/".join(low),
        f"{one}_{d[40]}_{low[1]}_{d[41]:03d}{low[2]}",
        "".join(title),
        f"20{d[40] % 30:02d}-{d[41] % 12 + 1:02d}-{d[42] % 28 + 1:02d}-{one}-{low[1]}",
        uuid if d[43] % 4 else uuid.upper(),
        (ALPHABETS[0] + "-_=")[d[40] % 67] * 24,
        f"ISBN978{number % 10**10}EDITION{d[40] % 9}" + (f"_{one}" if d[41] % 2 else ""),
    )
    form = d[-1] % len(made)
    return made[form] if len(made[form]) >= 20 else f"{made[form]}_{'_'.join(more[2:])}", form


def labelled_samples(spark: SparkSession, held_out: bool = False, samples: int = SAMPLES, words: str | None = None) -> DataFrame:
    """token, secret, form (number of its alphabet, or of how it is made): the half that is trained on, or the other one."""
    known, rows = vocabulary(words), []
    for k in range(2 * samples):
        d = hashlib.sha512(f"sample {k}".encode()).digest()
        if (d[-3] % 2 == 1) == held_out:
            token, form = _random(d) if k % 2 else _identifier(d, known)
            rows.append({"token": token, "secret": bool(k % 2), "form": form})
    # One constant: a few hundred bytes for each of at most 2 * samples rows.
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<token:string,secret:boolean,form:int>>")))


def train(samples: DataFrame) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) at 128 a + b, for characters of ASCII."""
    codes = F.transform(F.filter(F.split("token", ""), lambda c: c != ""), lambda c: F.ascii(c))
    pairs = samples.select("secret", codes.alias("c")).where("size(c) > 1").select("secret", F.explode(F.arrays_zip(F.expr("slice(c, 1, size(c) - 1)").alias("a"), F.expr("slice(c, 2, size(c) - 1)").alias("b"))).alias("p"))
    counts = pairs.select("secret", F.col("p")["a"].alias("a"), F.col("p")["b"].alias("b")).where("a < 128 AND b < 128").groupBy("secret", "a", "b").count()
    n: dict = {(bool(s), a, b): k for s, a, b, k in counts.collect()}  # at most 2 * 128 * 128 rows
    from_a, to_b, total = Counter(), Counter(), Counter()
    for (s, a, b), k in n.items():
        from_a[s, a] += k
        to_b[s, b] += k
        total[s] += k
    # A pair not seen falls back on how common its second character is.
    alone = lambda s, b: (to_b[s, b] + SMOOTH) / (total[s] + SMOOTH * ALPHABET)
    log = lambda s, a, b: math.log((n.get((s, a, b), 0) + BACK_OFF * alone(s, b)) / (from_a[s, a] + BACK_OFF))
    return [log(True, a, b) - log(False, a, b) for a in range(128) for b in range(128)]


def _running(steps: Column) -> Column:
    """Sums of all steps before each; in blocks, since an array that grows is copied at each step."""
    zero = F.array(F.lit(0))
    grow = lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda k: F.slice(steps, k * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
    bases = F.aggregate(sums, zero, grow)
    inner = F.zip_with(blocks, F.slice(bases, F.lit(1), F.size(blocks)), lambda b, base: F.slice(F.aggregate(b, F.array(base), grow), F.lit(1), F.size(b)))
    return F.when(F.size(steps) == 0, F.array().cast("array<int>")).otherwise(F.flatten(inner))


def _found(df: DataFrame, pattern: str, kind: str, keep) -> DataFrame:
    """Adds column kind: spans (start, k, end, value) of the pattern's matches that keep; empty without a match."""
    none = F.array().cast("array<string>")
    text = F.col("text")
    df = df.withColumn("fg_hit", text.rlike(pattern))
    df = df.withColumn("fg_m", F.when(F.col("fg_hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    gaps = F.when(F.col("fg_hit"), F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size("fg_m")), F.length)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("fg_gaps", gaps).withColumn("fg_steps", F.zip_with("fg_gaps", "fg_m", lambda g, m: g + F.length(m)))
    df = df.withColumn("fg_before", F.when(F.col("fg_hit"), _running(F.col("fg_steps"))).otherwise(F.array().cast("array<int>")))
    number = F.lit(KINDS.index(kind))
    starts = F.zip_with("fg_before", "fg_gaps", lambda b, g: b + g)
    spans = F.zip_with(starts, F.col("fg_m"), lambda s, m: F.struct(s.alias("start"), number.alias("k"), (s + F.length(m)).alias("end"), m.alias("value")))
    return df.withColumn(kind, F.filter(spans, lambda x: keep(x["value"]))).drop("fg_hit", "fg_m", "fg_gaps", "fg_steps", "fg_before")


def log_ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's character pairs; null below two characters."""
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.least(F.ascii(c), F.lit(127)))
    ratios = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")  # one constant, folded once
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.get(ratios, a * 128 + b))
    return F.when(F.length(token) > 1, F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / (F.length(token) - 1))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: DataFrame | None = None, least: float = LEAST, beside: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind, end, value) in order of start, then kind; then docs' columns that beside names. A row for each row.

    samples (token, secret; by default labelled_samples()) are what the models are counted from.
    """
    model = train(samples if samples is not None else labelled_samples(docs.sparkSession))
    kept = {f"fg_beside{k}": (name, docs.schema[place(docs, name)].dataType) for k, name in enumerate(beside)}
    df = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"), **kept).withColumn("text", F.coalesce("text", F.lit("")))
    df = _found(df, ASSIGN, "assign", lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= 8)
    df = _found(df, ACCESS, "access", lambda v: F.lit(True))
    df = _found(df, HEX, "hex", lambda v: F.lit(True))
    df = df.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    likely = lambda v: v.rlike("[A-Za-z]") & (log_ratio(v, model) > least)
    # Positions are worked out only where some token is likely at all.
    df = df.withColumn("fg_tokens", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).withColumn("fg_any", F.exists("fg_tokens", likely))
    df = df.withColumn("fg_text", F.col("text")).withColumn("text", F.when(F.col("fg_any"), F.col("text")).otherwise(F.lit("")))
    df = _found(df, TOKEN, "markov", likely)
    added = F.filter("markov", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    df = df.withColumn("all", F.array_sort(F.concat("base", added)))
    named = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))
    return df.select("doc_id", named("base").alias("base"), named("all").alias("spans"), *[F.col(own).alias(name) for own, (name, _) in kept.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(said("base").cast("binary"), 256).alias("base_sha256"), said("spans").alias("spans"))


def query_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with a held-out token at its end: doc_id, secret (what the token is), form, found (is it a span)."""
    docs = pick(table(spark, sf_dir, "documents"), doc_id=("doc_id", "long"), text=("text", "string"))
    held = labelled_samples(spark, held_out=True)
    tokens = held.select(F.col("secret"), F.col("form"), F.col("token"), (F.row_number().over(Window.orderBy(F.xxhash64("token"), "token")) - 1).alias("n"))  # 2 * SAMPLES rows at most
    size = tokens.count()
    planted = docs.withColumn("n", F.pmod(F.xxhash64("doc_id"), F.lit(size)).cast("int")).join(F.broadcast(tokens), "n")
    planted = planted.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" left here: "), "token"))
    found = scan(planted, beside=("secret", "form", "token"))  # by row: ids may be null or repeat
    return found.select("doc_id", "secret", "form", F.coalesce(F.get("spans", F.size("spans") - 1)["value"] == F.col("token"), F.lit(False)).alias("found"))
