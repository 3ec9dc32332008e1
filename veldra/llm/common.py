"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch of texts.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``.  Where that is unset, a cluster takes a folder of the
    warehouse, which is shared too, and a local session (tests) a temporary one."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("veldra.shared.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master == "local" or master.startswith("local["):
            found = "file://" + tempfile.mkdtemp(prefix="veldra-shared-")
        else:
            found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/veldra-scratch"
        spark.conf.set("veldra.shared.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back, so a lost executor never replays what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["scratch"] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete what :func:`materialize` wrote for these tables, once nothing will read them again."""
    for df in tables:
        path = df.__dict__.pop("scratch", None) if df is not None else None
        if path:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


#: Words of 64 bits in a filter: some 15 MB as a broadcast table at most, whatever it is made from.
FILTER_WORDS = 1 << 18


def _bits(key: str) -> tuple[str, str]:
    """(place of the word, the two bits in it) of a key."""
    h = f"xxhash64({key})"
    one = "shiftleft(cast(1 as bigint), cast({} & 63 as int))"
    return f"cast(shiftrightunsigned({h}, 20) % {FILTER_WORDS} as int)", f"({one.format(h)} | {one.format(f'shiftright({h}, 6)')})"


def _flagged(df: DataFrame, key: str, ids: DataFrame, name: str) -> DataFrame:
    """``df`` with a boolean ``__may``: false where ``key`` is surely not among ``ids``.

    A Bloom filter of a fixed number of words, built by an aggregation and broadcast.  More ids fill it, so that it
    lets more rows pass; it never grows and never drops a member."""
    place, bits = _bits(name)
    words = ids.select(F.expr(place).alias("__at"), F.expr(bits).alias("__bits")).groupBy("__at").agg(F.expr("bit_or(__bits)").alias("__word"))
    place, bits = _bits(key)
    found = df.withColumn("__at", F.expr(place)).join(F.broadcast(words), "__at", "left")
    return found.withColumn("__may", F.expr(f"coalesce((__word & {bits}) = {bits}, false)")).drop("__at", "__word")


def semi(df: DataFrame, key: str, ids: DataFrame, name: str | None = None) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the column ``name`` of ``ids``; only rows that pass the filter are shuffled."""
    name = name or key
    thin = _flagged(df, key, ids, name).where("__may").drop("__may")
    return thin.join(ids.select(F.col(name).alias("__id")), F.col(key) == F.col("__id"), "left_semi")


def thin(df: DataFrame, key: str, ids: DataFrame, name: str | None = None) -> DataFrame:
    """Rows of ``df`` that may have a partner in ``ids``: for the larger side of a join."""
    return _flagged(df, key, ids, name or key).where("__may").drop("__may")


def anti(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` isn't in ``ids``; rows that the filter clears stay where they are."""
    flagged = _flagged(df, key, ids, key)
    doubtful = flagged.where("__may").drop("__may")
    gone = doubtful.join(ids.select(F.col(key).alias("__id")), F.col(key) == F.col("__id"), "left_anti")
    return flagged.where("not __may").drop("__may").unionByName(gone)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces: bounds the texts that a worker holds as Python strings.  At the end of the task the
    worker, which lives on, gives freed memory back."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)


def whole_texts(docs: DataFrame) -> DataFrame:
    """``docs``, in a session that sends texts to Python in batches of at most ``BATCH_ROWS`` rows, so that the buffers
    on both sides stay small; a smaller number that the session asks for stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(docs.sparkSession.conf.get(name)) <= BATCH_ROWS:
        docs.sparkSession.conf.set(name, str(BATCH_ROWS))
    return docs


def default_parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser over uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
