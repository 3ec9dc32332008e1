"""Token-id output with keyed access (operator 3).

A store is a folder of Parquet rows, one per shard, each in a row group of its own with its first and last key, so
that a keyed read opens just the shards whose range holds the key.  A shard's ``blob`` is a self-contained container:

    magic "VTOK0002" | header: 8 x u64 | level sizes | bit words | ranks | fingerprints | first document | documents of
    the key | document ends | raw ids

All numbers are little-endian; ids have 2 bytes where all ids of the shard fit, else 4.  The bit words are a minimal
perfect hash over the shard's distinct keys: keys that collide on one level go on to the next; the rank of a key's
bit is its slot, from the stored count of bits before its 64-bit word and the bits inside the word.  A slot holds the
64-bit fingerprint of its key and the place of the key's documents, so a keyed read is one hash for each level (two
or three on average), one compare and one slice.  The fingerprint is a bijection of the key: it rejects every foreign
key, and the keys themselves need not be stored.

Shards follow ascending keys: the rows are dealt by ranges of (key, place in the input), sorted in their task and cut
at ``SHARD_IDS``, so a key that a third of all rows share is spread over many tasks and shards.  Texts are shuffled
once, before encoding; shard sizes are bounded and nothing is collected.

Cases: a null or empty text is a document of the end id alone; null keys come first and are read by scan only;
repeated keys keep all their documents, in the order of the input; other columns are ignored; an empty table gives a
store without shards.
"""

from __future__ import annotations

import functools
import operator
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import encoder
from .common import default_parallelism, mix64, shared_dir
from .tokens import vocabulary_path

MAGIC = b"VTOK0002"
#: A shard ends at the first document that brings it to so many ids or documents.
SHARD_IDS, SHARD_DOCS = 2_000_000, 50_000
GAMMA, SEED = 2, 0x5851F42D4C957F2D
SCHEMA = "part int, seq int, first_key long, last_key long, n_docs long, n_ids long, blob binary"
#: A row group is closed after each shard.
ROW_GROUPS = {"parquet.block.row.count.limit": "1"}
#: Keys of one lookup that are looked for in the ranges of the shards one by one; beyond that by their least and largest.
RANGED_KEYS = 64
_U = np.uint64
_SALT = _U(0x632BE59BD9B4E019)


def _level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    return mix64(keys.astype(np.uint64) ^ np.uint64((SEED * (2 * level + 1)) & ((1 << 64) - 1)))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return mix64(keys.astype(np.uint64) + _SALT)


def keys_of(prints: np.ndarray) -> np.ndarray:
    """The keys that have these fingerprints: the steps of ``mix64`` undone, last first."""
    x = prints.astype(np.uint64, copy=True)
    x ^= (x >> _U(31)) ^ (x >> _U(62))
    x *= _U(pow(0x94D049BB133111EB, -1, 1 << 64))
    x ^= (x >> _U(27)) ^ (x >> _U(54))
    x *= _U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    x ^= (x >> _U(30)) ^ (x >> _U(60))
    return (x - _SALT).astype(np.int64)


def build_mph(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits of each level, all bits in 64-bit words, set bits before each word) for distinct int64 keys."""
    sizes, bits, left, level = [], [], keys, 0
    while len(left):
        size = max(64, GAMMA * len(left))
        at = (_level_hash(left, level) % np.uint64(size)).astype(np.int64)
        once = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(once)
        left = left[~once[at]]
        level += 1
    flat = np.concatenate([*bits, np.zeros(-sum(sizes) % 64, bool)]) if bits else np.empty(0, bool)
    words = np.packbits(flat, bitorder="little").view("<u8")
    counts = np.bitwise_count(words).astype(np.int64)
    return np.array(sizes, np.uint64), words, (np.cumsum(counts) - counts).astype(np.uint32)


def mph_slots(keys: np.ndarray, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 for a key that no level holds."""
    out, todo, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes.tolist()):
        if not len(todo):
            break
        at = _U(base) + _level_hash(keys[todo], level) % _U(size)
        word, bit = words[at >> _U(6)], at & _U(63)
        hit = (word >> bit & _U(1)).astype(bool)
        inside = np.bitwise_count(word & ((_U(1) << bit) - _U(1)))
        out[todo[hit]] = (ranks[at >> _U(6)].astype(np.int64) + inside)[hit]
        todo, base = todo[~hit], base + size
    return out


def pack_shard(keys: list[int | None], ids: list[bytes]) -> bytes:
    """One container.  Keys ascend, nulls first; ids are packed 32-bit values."""
    nulls = np.array([k is None for k in keys], bool)
    own = np.array([0 if k is None else k for k in keys], np.int64)
    first = np.flatnonzero(~nulls & np.concatenate([[True], (own[1:] != own[:-1]) | nulls[:-1]]))
    distinct = own[first]
    count = np.diff(np.append(first, len(own)))
    sizes, words, ranks = build_mph(distinct)
    slot = mph_slots(distinct, sizes, words, ranks)
    prints, at, many = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint32), np.zeros(len(first), np.uint32)
    prints[slot], at[slot], many[slot] = fingerprints(distinct), first, count
    ends = np.cumsum([len(i) // 4 for i in ids]).astype(np.uint64)
    raw = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if raw.max(initial=0) < 1 << 16 else 4
    header = struct.pack("<8Q", len(keys), len(first), len(sizes), len(words), width, len(raw), 0, 0)
    return MAGIC + header + b"".join(x.tobytes() for x in (sizes, words, ranks, prints, at, many, ends, raw.astype(f"<u{width}")))


class Shard:
    """A parsed container: views into the blob, nothing is copied or summed."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.docs, keys, levels, words, self.width, n, *_ = struct.unpack_from("<8Q", blob, 8)
        at = 72

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(blob, kind, count, at)
            at += found.nbytes
            return found

        self.sizes, self.words, self.ranks = take("<u8", levels), take("<u8", words), take("<u4", words)
        self.prints, self.first, self.many = take("<u8", keys), take("<u4", keys), take("<u4", keys)
        self.ends, self.raw = take("<u8", self.docs), take(f"<u{self.width}", n)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first document, number of documents) of each key; 0 documents for a key that isn't there."""
        slot = mph_slots(keys, self.sizes, self.words, self.ranks)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == fingerprints(keys[known])
        first, many = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[known], many[known] = self.first[slot[known]], self.many[slot[known]]
        return first, many

    def start(self, document: int) -> int:
        return int(self.ends[document - 1]) if document else 0

    def ids(self, document: int) -> np.ndarray:
        return self.raw[self.start(document) : int(self.ends[document])].astype("<u4")


def write_store(docs: DataFrame, path: str, vocabulary: str, kind: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, end each with ``end_id`` and write the shards to ``path``."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seq = encoder(kind, vocabulary), TaskContext.get().partitionId(), 0
        keys, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                "first_key": pa.array([next((k for k in keys if k is not None), None)], pa.int64()), "last_key": pa.array([keys[-1]], pa.int64()),
                "n_docs": [len(keys)], "n_ids": [held // 4], "blob": pa.array([pack_shard(keys, ids)], pa.binary()),
            })

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for key, packed in zip(piece.column(0).to_pylist(), own.encode(piece.column(1).to_pylist()), strict=True):
                    keys.append(key)
                    ids.append(packed + end)
                    held += len(packed) + 4
                    if held >= 4 * SHARD_IDS or len(keys) >= SHARD_DOCS:
                        yield flush()
                        seq, keys, ids, held = seq + 1, [], [], 0
        if keys:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("key").asc_nulls_first(), F.col("place").asc()]
    dealt = rows.repartitionByRange(default_parallelism(docs.sparkSession), *order).sortWithinPartitions(*order)
    dealt.select("key", "text").mapInArrow(run, SCHEMA).write.options(**ROW_GROUPS).parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, base): ids before each shard.  Sums run within a part, then over the parts' totals."""
    own = spark.read.schema(SCHEMA).parquet(path).select("part", "seq", "n_ids")
    parts = own.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = parts.select("part", (F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("total")).alias("lead"))
    inner = F.sum("n_ids").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_ids")
    return own.withColumn("inner", inner).join(before, "part").select("part", "seq", (F.col("lead") + F.col("inner")).alias("base"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document; keyed ones are fetched through the hash index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                shard = Shard(blob)
                distinct = keys_of(shard.prints)
                first, many = shard.find(distinct)
                if (many == 0).any() or (first != shard.first).any():
                    raise ValueError("the shard's index misses keys that it stores")
                order = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
                keys, nulls = np.zeros(shard.docs, np.int64), np.ones(shard.docs, bool)
                keys[order], nulls[order] = np.repeat(distinct, many), False
                ends = shard.ends.astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                order = np.concatenate([np.flatnonzero(nulls), order]).astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * len(order), pa.int32()), "seq": pa.array([seq] * len(order), pa.int32()),
                    "doc_id": pa.array(keys[order], pa.int64(), mask=nulls[order]),
                    "local": pa.array(starts[order], pa.int64()),
                    "n_tokens": pa.array(ends[order] - starts[order], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(shard.ids(i).tobytes()) for i in order.tolist()], pa.int64()),
                })

    stored = spark.read.schema(SCHEMA).parquet(path).select("part", "seq", "blob")
    rows = stored.mapInArrow(run, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    joined = rows.join(shard_starts(spark, path), ["part", "seq"])
    return joined.select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """(key, ids) of the documents of a few keys.  The ranges in the row groups' statistics lead to the shards, the
    hash index of a shard to the documents."""
    wanted = np.unique(np.array(keys, np.int64))
    if not len(wanted):
        return spark.createDataFrame([], "key long, ids array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                shard = Shard(blob)
                for key, first, many in zip(wanted.tolist(), *(x.tolist() for x in shard.find(wanted)), strict=True):
                    for i in range(first, first + many):
                        yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int64()), "ids": pa.array([shard.ids(i).tolist()], pa.list_(pa.int64()))})

    ends = [(k, k) for k in wanted.tolist()] if len(wanted) <= RANGED_KEYS else [(int(wanted[0]), int(wanted[-1]))]
    inside = functools.reduce(operator.or_, [(F.col("first_key") <= high) & (F.col("last_key") >= low) for low, high in ends])
    return spark.read.schema(SCHEMA).parquet(path).where(inside).select("blob").mapInArrow(run, "key long, ids array<long>")


def digests(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """The op3 query: write the store, read it back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_store(docs, path, vocabulary_path(vocabulary), "byte", end_id)
    return read_documents(spark, path)
