"""Token files with fixed-width bit packing.

Each id takes the fewest bits that the vocabulary needs. A file is a sequence of blocks; a block holds up to
BLOCK_IDS ids of whole documents (a longer document has a block of its own):

    "FGTB", version u8, width u8, 2 zero bytes, documents u32, ids u64, then for each document its id i64 and
    the end of its ids in the block u64, then the packed ids, lowest bit first. All little-endian.

Ids have one width, so any range of a block is read by its place alone, and numpy unpacks it whole. Blocks are
written through Spark's writer as rows (shard, block, before, n_ids, data), so a lost executor's files are written
again and any store works; shards hold ascending document ids, and `before` counts the shard's ids ahead of a block.

Any file of the tokenizers library can be used. Where its rules are those of BY_WORDS, under which no token spans ASCII
white space, distinct words are encoded once and kept in a bounded cache; else whole texts are encoded.

Defined results: null text is empty (its document has the end id alone). Null document ids come last. Rows that
repeat an id are documents each, in the order of a hash of their texts, by which a frequent or null id is dealt out too.
Very long texts stay whole. An empty table gives no block, and no row when read. Other columns, whatever their names,
are not read. The width also holds the end id.
"""

from __future__ import annotations

import json
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, Generations, pack, parts_for, pick, scratch, table, unpack

MAGIC = b"FGTB"
HEAD = struct.Struct("<4sBBxxIQ")
BLOCK_IDS = 1 << 20
END_ID = 2
CACHED = 600_000
#: Rules of a vocabulary (normalizer, pre_tokenizer) under which a text's ids are its words' ids. Fixed values.
BY_WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)
MARKS = (b",", b".", b";", b":", b"!", b"?")
BLOCKS = "shard long, block long, before long, n_docs long, n_ids long, data binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def block(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray, width: int) -> bytes:
    """A block of documents, whose ids end at the given places."""
    keys = np.array([NULL_ID if d is None else d for d in doc_ids], "<i8")
    head = HEAD.pack(MAGIC, 1, width, len(keys), len(ids))
    return head + keys.tobytes() + np.ascontiguousarray(ends, "<u8").tobytes() + pack(ids, width)


class Block:
    """Random access to a block's documents and ids."""

    def __init__(self, data: bytes):
        magic, version, self.width, n, self.n_ids = HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token block")
        self.doc_ids = np.frombuffer(data, "<i8", n, HEAD.size)
        self.ends = np.frombuffer(data, "<u8", n, HEAD.size + 8 * n).astype(np.int64)
        self.packed = memoryview(data)[HEAD.size + 16 * n :]

    def ids(self, first: int = 0, n: int | None = None) -> np.ndarray:
        return unpack(self.packed, self.width, self.n_ids - first if n is None else n, first).astype(np.uint32)

    def document(self, k: int) -> np.ndarray:
        first = int(self.ends[k - 1]) if k else 0
        return self.ids(first, int(self.ends[k]) - first)


class Encoder:
    def __init__(self, path: str, end_id: int = END_ID):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.end_id = Tokenizer.from_file(path), Generations(CACHED), end_id
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        rules = json.loads(self.tokenizer.to_str())
        # Strings of added tokens are looked for in whole texts, before anything else; all of these hold <| then.
        self.by_words = (rules["normalizer"], rules["pre_tokenizer"]) == BY_WORDS and rules["model"]["type"] == "BPE" and all("<|" in t["content"] for t in rules["added_tokens"])
        self.width = max(1, max(end_id, *self.tokenizer.get_vocab().values()).bit_length())

    def _learn(self, new: list[bytes]) -> None:
        """Ids (32 bits each) of words not known yet, all in one call."""
        found = self.tokenizer.encode([w.decode() for w in new], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        at = (4 * np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(new) + 1))).tolist()
        self.known.update(zip(new, [ids[a:b] for a, b in zip(at, at[1:])], strict=True))  # noqa: B905

    def _values(self, vocabulary: list[bytes]) -> list[bytes]:
        """Ids (32 bits each) of distinct words."""
        known = self.known
        known.trim()
        new = set(vocabulary).difference(known, known.old)
        # A mark after an ASCII letter or digit is a piece of its own, so words with and without it share their ids.
        marked = [w for w in new if w[-1:] in MARKS and w[-2:-1].isalnum()]
        new.difference_update(marked)
        new.update({w[:-1] for w in marked}.difference(known, known.old), MARKS)
        self._learn(list(new))
        known.update((w, known[w[:-1]] + known[w[-1:]]) for w in marked)
        return list(map(known.__getitem__, vocabulary))

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, the end id after each, and where each text's ids end."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not self.by_words:
            each = [x.ids for x in self.tokenizer.encode_batch(column.to_pylist(), add_special_tokens=False)]
            ends = np.cumsum([len(x) + 1 for x in each], dtype=np.int64)
            return np.fromiter((i for x in each for i in (*x, self.end_id)), np.uint32, int(ends[-1]) if len(ends) else 0), ends
        # The vocabulary is in lower case; only the strings of special tokens are looked for before that.
        column = pc.if_else(pc.match_substring(column, "<|"), column, pc.ascii_lower(column))
        split = pc.ascii_split_whitespace(column)
        words = split.flatten().dictionary_encode()
        values = self._values(words.dictionary.cast(pa.binary()).to_pylist())
        # The end id is one more word, which comes after each text.
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        offsets = np.concatenate([[0], np.cumsum(sizes), [sizes.sum() + 1]]).astype(np.int32)
        ids = np.frombuffer(b"".join(values) + np.uint32(self.end_id).tobytes(), "<u4")
        bounds = split.offsets.to_numpy().astype(np.int64)
        last = np.zeros(len(words) + len(bounds) - 1, bool)
        last[bounds[1:] - bounds[0] + np.arange(len(bounds) - 1)] = True
        index = np.full(len(last), len(values), np.int32)
        index[~last] = words.indices.to_numpy()
        found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)).take(pa.array(index))
        return found.flatten().to_numpy(), found.offsets.to_numpy()[1:][last].astype(np.int64)


def pieces(texts: pa.Array, most: int = 8 << 20):
    """Ranges of rows with about so many bytes of text each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


@cache
def encoder(path: str, end_id: int = END_ID) -> Encoder:
    return Encoder(path, end_id)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS, part_bytes: int = 16 << 20) -> None:
    """Encode documents in ascending order of their ids into blocks below path."""
    vocabulary = tokenizer or default_tokenizer()

    def run(batches):
        own, shard = encoder(vocabulary, end_id), TaskContext.get().partitionId()
        number = before = held = 0
        doc_ids: list = []
        parts: list[np.ndarray] = []

        def flush():
            nonlocal number, before, held, doc_ids, parts
            ids = np.concatenate(parts)
            data = block(doc_ids, ids, np.cumsum([len(p) for p in parts]), own.width)
            row = pa.record_batch({"shard": [shard], "block": [number], "before": [before], "n_docs": [len(doc_ids)], "n_ids": [len(ids)], "data": pa.array([data], pa.binary())})
            number, before, held, doc_ids, parts = number + 1, before + len(ids), 0, [], []
            return row

        for batch in batches:
            texts, keys = batch.column("text"), batch.column("doc_id").to_pylist()
            for a, b in pieces(texts):
                ids, ends = own.encode(texts.slice(a, b - a))
                for k, one in enumerate(np.split(ids, ends[:-1])):
                    if doc_ids and held + len(one) > block_ids:
                        yield flush()
                    doc_ids.append(keys[a + k])
                    parts.append(one)
                    held += len(one)
        if doc_ids:
            yield flush()

    rows = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    n = parts_for(rows, "text", part_bytes)
    order = F.col("doc_id").asc_nulls_last(), F.col("tie")
    rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order, "text").select("doc_id", "text").mapInArrow(run, BLOCKS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """BLOCKS with base: the ids of all shards before the block's. Shards are as few as partitions: MOST_PARTS, or the session's own number."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select(F.col("shard").alias("s"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return blocks.join(F.broadcast(bases), F.col("shard") == F.col("s")).drop("s")


def digests(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in read()'s blocks."""

    def run(batches):
        for batch in batches:
            for data, start in zip(batch.column("data").to_pylist(), batch.column("start").to_pylist(), strict=True):
                own = Block(data)
                ids = own.ids()
                firsts = np.concatenate([[0], own.ends])[:-1]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(firsts.tolist(), own.ends.tolist(), strict=True)]
                yield pa.record_batch({"doc_id": pa.array(own.doc_ids, mask=own.doc_ids == NULL_ID), "start": pa.array(firsts + start), "n_tokens": pa.array(own.ends - firsts), "ids_crc32": pa.array(crc, pa.int64())})

    return blocks.select("data", (F.col("base") + F.col("before")).alias("start")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path)
    return digests(read(spark, path))
