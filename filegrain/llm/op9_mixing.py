"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in an order drawn by a hash of their ids, form blocks of block_chars characters. With a
source's share a of M = sum of all shares, its block i is released at slot floor(i M / a) and due by slot
ceil((i + 1) M / a). Earliest deadline first over these windows gives each slot to one source, and after any number
of slots each source is less than one block away from its target. Shares are whole numbers, so the schedule repeats
after M slots: M slots are laid out once (M <= MOST_SLOTS, whatever the input's size), and block i of a source goes
to slot (i div a) M + (slot of block i mod a). A block's slot is thus arithmetic on its number; nothing is simulated
over the corpus, and no order of all rows is needed.

A block's number needs the running size of its source. It is found in two levels, so that no task gets a whole
source: sums by (source, hash range), whose running total is a small table, and running sums inside a range. Ranges
are so many that the largest source has RANGE_CHARS in each (up to 2^20 of each source, far beyond 100 TB). A document
belongs to the block in which it begins; one longer than a block leaves the next slots empty. When a source has no
blocks left its slots stay empty and the others keep theirs: no row is dropped or repeated, and the deviation bound
holds up to the first source's end (first_end).

The documents are read twice: once for the sums, once for their places. arranged() puts them in order by one more
shuffle: parts are cut at slots, by what the sums say of the slots' sizes, so nothing is sampled or sorted globally.

Defined results: sources without a share, and null ones, are pooled as one more source with the share rest. Null
text has size zero. The order in a source is by a hash of the id, and of the text for null ids, so that these are
dealt out as well; then by id, size and a hash of the text. Rows that are equal in all of these are interchangeable:
each has a place of its own. Very long texts stay whole. An empty table gives an empty one. What is added has a
prefix that no column of docs has, so all of these stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MOST_PARTS, at, checkpointed, named, numbered, own_prefix, pick, table

BLOCK_CHARS = 1 << 16
MOST_SLOTS = 10_000
#: Characters of the largest source in a hash range; the number of a source's ranges as a power of two.
RANGE_CHARS = 32 << 20
LEAST_BITS, MOST_BITS = 8, 20
#: Running totals of ranges (some 60 bytes each) up to this number go to every task; more are joined by the window's own partitioning.
BROADCAST_RANGES = 250_000
SEED = "mix"
#: Shares of the sources of the synthetic tables; src0 is the largest.
SHARES = {f"src{k}": 8 if k == 0 else 1 + k % 4 for k in range(20)}


def schedule(shares: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, number of its block, slot) for the M slots after which the schedule repeats."""
    total = sum(shares.values())
    if not shares or min(shares.values()) < 1 or total > MOST_SLOTS:
        raise ValueError(f"shares must be whole numbers from 1 with a sum of at most {MOST_SLOTS}")
    done, out = dict.fromkeys(sorted(shares), 0), []
    for slot in range(total):
        ready = [(-(-(i + 1) * total // shares[s]), s) for s, i in done.items() if i < shares[s] and i * total // shares[s] <= slot]
        _, source = min(ready)
        out.append((source, done[source], slot))
        done[source] += 1
    return out


class Mix:
    """Places of docs' rows in a mix of their sources.

    measured: columns of docs with each text's length and hash, if they are known already; else text_col is measured.
    """

    def __init__(self, docs: DataFrame, shares: dict[str, int], id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", rest: int = 1, block_chars: int = BLOCK_CHARS, seed: str = SEED, measured: tuple[str, str] | None = None):
        shares = {str(k): int(v) for k, v in shares.items()}
        other = "(rest)"
        while other in shares:
            other = f"({other})"
        shares[other] = rest
        self.docs, self.block_chars, self.total, self.prefix = docs, block_chars, sum(shares.values()), own_prefix(docs)
        self.plan = docs.sparkSession.createDataFrame([(s, shares[s], i, slot) for s, i, slot in schedule(shares)], "p string, share long, i long, place long")
        self.id = at(docs, id_col)
        source = F.col(at(docs, source_col)).cast("string")
        if measured:
            size, tie = (F.col(at(docs, c)) for c in measured)
        else:
            text = F.coalesce(F.col(at(docs, text_col)).cast("string"), F.lit(""))
            size, tie = F.length(text).cast("long"), F.xxhash64(text)
        key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(self.id).cast("string"), F.concat(F.lit("null:"), F.hex(tie)))))
        stream = F.when(source.isin([s for s in shares if s != other]), source).otherwise(F.lit(other))
        self.keyed = numbered(docs).withColumns({"stream": stream, "key": key, "size": size, "tie": tie})
        fine = F.conv(F.substring("key", 1, MOST_BITS // 4), 16, 10).cast("int").alias("fine")
        # At most 2^20 rows of each source, whatever the input's size.
        sums = checkpointed(self.keyed.groupBy("stream", fine).agg(F.sum("size").alias("chars"), F.count("*").alias("n")))
        self.chars, largest, groups = sums.groupBy("stream").agg(F.sum("chars").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.max("c"), F.lit(0)), F.count("*")).first()
        bits = max(LEAST_BITS, min(MOST_BITS, (largest // RANGE_CHARS).bit_length()))
        shift = MOST_BITS - bits
        self.keyed = self.keyed.withColumn("range", F.shiftright(F.conv(F.substring("key", 1, MOST_BITS // 4), 16, 10).cast("int"), shift))
        folded = sums.groupBy("stream", F.shiftright("fine", shift).alias("range")).agg(F.sum("chars").alias("chars"))
        before = Window.partitionBy("stream").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        self.bases = folded.withColumn("base", F.coalesce(F.sum("chars").over(before), F.lit(0)))
        self.small = groups << bits <= BROADCAST_RANGES

    def _slots(self, rows: DataFrame, begin: str) -> DataFrame:
        """rows (stream, begin) with block and slot."""
        shares = F.broadcast(self.plan.select("p", "share").distinct())
        rows = rows.withColumn("block", F.floor(F.col(begin) / F.lit(self.block_chars)).cast("long")).join(shares, F.col("stream") == F.col("p")).drop("p")
        rows = rows.join(F.broadcast(self.plan.drop("share")), (F.col("stream") == F.col("p")) & (F.col("block") % F.col("share") == F.col("i")))
        return rows.withColumn("slot", F.expr("block div share") * F.lit(self.total) + F.col("place")).drop("p", "share", "i", "place")

    def _placed(self) -> DataFrame:
        inside = Window.partitionBy("stream", "range").orderBy("key", self.id, "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
        rows = self.keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        bases = self.bases.drop("chars")
        rows = rows.join(F.broadcast(bases) if self.small else bases, ["stream", "range"]).withColumn("begin", F.col("base") + F.col("inside"))
        return self._slots(rows, "begin")

    def _named(self, rows: DataFrame) -> DataFrame:
        return named(self.docs, rows, *[F.col(c).alias(self.prefix + c) for c in ("stream", "begin", "block", "slot", "key")])

    def rows(self) -> DataFrame:
        """docs with fg_stream, fg_begin (characters before it in its source), fg_block, fg_slot, fg_key (order within a slot). A row for each row."""
        return self._named(self._placed())

    def arranged(self, part_chars: int = 32 << 20) -> DataFrame:
        """The same in the order of their slots, over partitions of about so many characters, at most MOST_PARTS."""
        parts = max(int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, -(-self.chars // part_chars)))
        # Slots in 4 * parts groups of one width, with the characters of the ranges that begin there: a bounded table.
        ranges = self._slots(self.bases, "base")
        width = max(1, -(-(int(ranges.agg(F.max("slot")).first()[0] or 0) + 1) // (4 * parts)))
        group = F.least(F.expr(f"slot div {width}"), F.lit(4 * parts))
        sizes = ranges.groupBy(group.alias("g")).agg(F.sum("chars").alias("c"))
        every = self.docs.sparkSession.range(4 * parts + 1).toDF("g").join(sizes, "g", "left")
        upto = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
        part = F.floor(F.coalesce(F.sum("c").over(upto), F.lit(0)) * F.lit(parts) / F.lit(max(1, self.chars)))
        cuts = every.select("g", F.least(part, F.lit(parts - 1)).cast("int").alias("part"))
        rows = self._placed().withColumn("g", group).join(F.broadcast(cuts), "g")
        return self._named(rows.repartitionById(parts, F.col("part")).sortWithinPartitions("slot", "key", self.id, "size", "tie"))


def mixed(docs: DataFrame, shares: dict[str, int], **options) -> DataFrame:
    """Mix(...).rows()"""
    return Mix(docs, shares, **options).rows()


def first_end(mix: DataFrame, prefix: str = "fg_") -> int:
    """The last slot that the source which ends first fills: up to it the deviation bound holds for all."""
    row = mix.groupBy(f"{prefix}stream").agg(F.max(f"{prefix}slot").alias("last")).agg(F.min("last")).first()
    return -1 if row[0] is None else int(row[0])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id=("doc_id", "long"), source=("source", "string"), text=("text", "string"))
    text = F.coalesce("text", F.lit(""))
    known = checkpointed(docs.select("doc_id", "source", F.length(text).cast("long").alias("size"), F.xxhash64(text).alias("tie")))
    mix = checkpointed(mixed(known, SHARES, measured=("size", "tie")).drop("size", "tie", "fg_key"))
    out = mix.select("doc_id", "source", F.col("fg_stream").alias("stream"), F.col("fg_begin").alias("begin"), F.col("fg_block").alias("block"), F.col("fg_slot").alias("slot"))
    return out.withColumn("in_mix", F.col("slot") <= first_end(mix))


def _oracle() -> str:
    shares = SHARES | {"(rest)": 1}
    total = sum(shares.values())
    plan = ", ".join(f"('{s}', {shares[s]}, {i}, {slot})" for s, i, slot in schedule(shares))
    return f"""
WITH plan(stream, share, i, place) AS (VALUES {plan}
), d AS (
  SELECT doc_id, source, CASE WHEN source IN (SELECT stream FROM plan WHERE stream <> '(rest)') THEN source ELSE '(rest)' END AS stream,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k, length(coalesce(text, '')) AS size FROM documents
), b AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY stream ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin FROM d
), s AS (
  SELECT doc_id, source, b.stream, begin, begin // {BLOCK_CHARS} AS block, (begin // {BLOCK_CHARS}) // share * {total} + place AS slot
  FROM b JOIN plan ON b.stream = plan.stream AND (begin // {BLOCK_CHARS}) % share = i
)
SELECT doc_id, source, stream, begin, block, slot, slot <= (SELECT min(m) FROM (SELECT max(slot) AS m FROM s GROUP BY stream)) AS in_mix FROM s
"""


ORACLE = _oracle()
