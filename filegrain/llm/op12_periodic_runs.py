"""Periodic runs of words, by a suffix automaton with small-to-large merging of ordered end-position sets.

The automaton of a word sequence has a state for each class of its factors with the same end positions. Along suffix
links, from the longest states up, each state's ordered set of ends is merged into its parent's, the smaller set into the
larger one. Ends that become neighbours in a state seed a square if their distance p does not exceed the state's length:
that factor then occurs twice, p apart, without another occurrence between them, so p is the smallest period of what the
two cover. The state's length is the longest common suffix at those ends, so the stretch can't be extended to the left
with that period; the last pair of ends of a stretch shows where it ends on the right. A seed with the same period that
starts at the same word is the same run.

Only parts of a text can hold a run that is asked for. In a run of length >= max(6, 4 * period) every window of three
words occurs three times or more, so places whose window is rarer in the text cut it, and the automaton is built for what
lies between such cuts, if it is long enough. This drops nothing: a run lies within one such part, with its neighbours.

A text is read whole by one task; memory follows its longest part that repeats itself, about 1 KB a word. Tasks take
texts as they come, without a shuffle, so no key can be hot.

Defined results: null and empty texts have no words and no runs. Rows are judged each by itself, so nulls, ties and
repeats of ids change nothing, and an empty table gives an empty one. Of runs, the longest is the one with the smallest
start, then period. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table, words
from .op8_token_files import pieces

LEAST_LENGTH = 6
LEAST_TIMES = 4
#: Words of a window whose repeats a part of a text needs.
WINDOW = 3
RUNS = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))


class Automaton:
    """Suffix automaton of a sequence of hashable items; state 0 is the root."""

    def __init__(self, items):
        self.length, self.link, self.next, self.end = [0], [-1], [{}], [-1]
        length, link, following, ends = self.length, self.link, self.next, self.end
        last = 0
        for place, item in enumerate(items):
            now = len(length)
            length.append(length[last] + 1)
            link.append(0)
            following.append({})
            ends.append(place)
            at = last
            while at >= 0 and item not in following[at]:
                following[at][item] = now
                at = link[at]
            if at >= 0:
                to = following[at][item]
                if length[to] == length[at] + 1:
                    link[now] = to
                else:
                    copy = len(length)
                    length.append(length[at] + 1)
                    link.append(link[to])
                    following.append(following[to].copy())
                    ends.append(-1)
                    while at >= 0 and following[at].get(item) == to:
                        following[at][item] = copy
                        at = link[at]
                    link[to] = link[now] = copy
            last = now


def merged(large: list[int], small: list[int]) -> list[tuple[int, int]]:
    """Put small's places into large, both sorted; returns pairs that are neighbours now, one from each."""
    if len(small) == 1:
        x = small[0]
        i = bisect_left(large, x)
        out = []
        if i:
            out.append((large[i - 1], x))
        if i < len(large):
            out.append((x, large[i]))
        large.insert(i, x)
        return out
    out, gap, last = [], -1, 0
    for x in small:
        i = bisect_left(large, x)
        if i != gap:  # the first of small's places in this gap; last was the last one in its own
            if gap >= 0 and gap < len(large):
                out.append((last, large[gap]))
            if i:
                out.append((large[i - 1], x))
            gap = i
        last = x
    if gap < len(large):
        out.append((last, large[gap]))
    if len(small) * 8 > len(large):
        large += small
        large.sort()  # two sorted stretches: one pass
    else:
        for x in small:
            insort(large, x)
    return out


def squares(items) -> dict[tuple[int, int], int]:
    """(start, period) -> last place, of all runs: stretches that hold their smallest period twice or more and can't be extended."""
    auto = Automaton(items)
    length, link = auto.length, auto.link
    ends = [[e] if e >= 0 else [] for e in auto.end]
    seeds: dict[int, list[tuple[int, int]]] = {}
    found: dict[tuple[int, int], int] = {}
    for state in np.argsort(-np.array(length), kind="stable")[:-1].tolist():  # longest first, without the root
        own = ends[state]
        for a, b in seeds.pop(state, ()):  # its set is complete: are they neighbours still?
            if own[bisect_left(own, a) + 1] == b:
                key = a - length[state] + 1, b - a
                if found.get(key, -1) < b:
                    found[key] = b
        to = link[state]
        if not to:
            ends[state] = []
            continue
        into = ends[to]
        if len(into) < len(own):
            into, own = own, into
        ends[to], ends[state] = into, []
        near = [(a, b) for a, b in merged(into, own) if b - a <= length[to]] if own else []
        if near:
            seeds.setdefault(to, []).extend(near)
    return found


def repeated_parts(items: list, window: int = WINDOW, times: int = 3) -> list[tuple[int, int]]:
    """Stretches [a, b) in which each window occurs so often in all items, as long as they can be."""
    n = len(items) - window + 1
    if n < times:
        return []
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in items), np.int64, len(items))
    key, distinct = ids[:n], len(number)
    for k in range(1, window):
        key = key * distinct + ids[k : n + k]
        if k < window - 1 and distinct > 1 << 20:  # so that the next product stays below 2^63
            key = np.unique(key, return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.diff(key[order], prepend=key[order[0]] - 1, append=key[order[-1]] + 1))
    count = np.empty(n, np.int64)
    count[order] = np.repeat(np.diff(edge), np.diff(edge))
    cut = np.flatnonzero(np.diff((count >= times).astype(np.int8), prepend=0, append=0))
    return [(a, b + window - 1) for a, b in cut.reshape(-1, 2).tolist()]


def runs(items: list, least: int = LEAST_LENGTH, times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) by start, then period: stretches with that smallest period, of max(least, times * period) items or more, that no neighbour extends."""
    # A window of w items within a run of L occurs in it at L - w + 1 places, of any residue at least (L - w + 1) // period.
    window = WINDOW if least >= 6 and times >= 4 else 1
    often = 3 if window > 1 else max(2, times)
    out = []
    for a, b in repeated_parts(items, window, often):
        if b - a >= least:
            out += [(a + s, e - s + 1, p) for (s, p), e in squares(items[a:b]).items() if e - s + 1 >= max(least, times * p)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_places(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Of n items, which stay if each run keeps its first period alone."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, times: int = LEAST_TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period: in words, by start, then period), collapsed (words joined by one space, each run cut to its first period); a row for each row of docs."""

    def run(batches):
        for batch in batches:
            for a, b in pieces(batch.column("text"), 4 << 20):
                sizes, lists, said = [], [], []
                for text in batch.column("text").slice(a, b - a):
                    split = words(text.as_py())
                    found = runs(split, least, times)
                    kept = split if not found else [split[i] for i in np.flatnonzero(kept_places(len(split), found)).tolist()]
                    sizes.append(len(split))
                    lists.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                    said.append(b" ".join(kept).decode())
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(lists, RUNS), pa.array(said, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return pick(docs, doc_id=(id_col, "long"), text=(text_col, "string")).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def looped(docs: DataFrame) -> DataFrame:
    """doc_id, text of documents, in which one document of ten repeats a stretch of its own words to its end."""
    rows = pick(docs, doc_id=("doc_id", "long"), text=("text", "string")).withColumn("h", F.crc32(F.col("doc_id").cast("string")))
    split = F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")
    a, p = F.expr("g % n"), F.expr("1 + (n - g % n) div (3 + g % 8)")
    say = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.element_at(F.col("w"), (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int")))
    # Words are split where they change alone; others pass as they are.
    some = rows.where("h % 10 = 0").select("doc_id", "text", F.expr("h div 10").alias("g"), split.alias("w")).withColumn("n", F.size("w").cast("long"))
    changed = some.select("doc_id", F.when(F.col("n") > 0, F.array_join(say, " ")).otherwise(F.col("text")).alias("text"))
    return rows.where("h IS NULL OR h % 10 <> 0").select("doc_id", "text").unionByName(changed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(looped(table(spark, sf_dir, "documents")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS back, -r.period AS short)))")
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    rows = found.withColumn("best", best).withColumn("n_runs", F.size("runs").cast("long"))
    return rows.select(
        "doc_id",
        "n_runs",
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.short")).alias("period"),
        F.expr("(1000 * best.length) div (-best.short)").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
