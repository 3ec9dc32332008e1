"""A grid of (row block, query block) tasks over a vector table, and the merge of their answers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a row block and of a query block (512 bytes a row at 64 components).
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096
SCHEMA = "query_id long, vec_id long, score {}"


def clean(vectors: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """(vec_id, v, dim) without vectors that are null, empty, or hold null or non-finite components; without zero
    vectors unless ``zero``.  Rows with a null id take no part, and repeated rows count once."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.withColumn("dim", F.size("v"))


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, rows of doubles), repeated rows once."""
    ids = table.column("vec_id").to_numpy()
    if not len(ids):
        return ids, np.empty((0, 0))
    rows = np.asarray(table.column("v").combine_chunks().flatten(), np.float64).reshape(len(ids), -1)
    if len(np.unique(ids)) == len(ids):
        return ids, rows
    first = list({(i, r.tobytes()): n for n, (i, r) in reversed(list(enumerate(zip(ids.tolist(), rows, strict=True))))}.values())
    return ids[first], rows[first]


def top_k(rows: DataFrame, is_query, k: int, search: Callable, kind: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``search(row_ids, rows, query_ids, queries)`` answers one task with arrays (query_id, vec_id, score); the best
    k of each query over all tasks are kept, ties to the smaller vec_id.  Vectors only meet vectors of their length.

    A stated query set meets all rows in blocks: rows are copied once per query block, queries once per row block.
    """
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    row_blocks, query_blocks = 1 + sizes["n"] // block_rows, 1 + sizes["q"] // BLOCK_QUERIES
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    left = rows.select("dim", of(row_blocks, 1).alias("rb"), every(query_blocks).alias("qb"), F.lit(False).alias("asks"), "vec_id", "v")
    right = rows.where(is_query).select("dim", every(row_blocks).alias("rb"), of(query_blocks, 2).alias("qb"), F.lit(True).alias("asks"), "vec_id", "v")

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids, own = matrix(table.filter(pa.array(~asks)))
        query_ids, queries = matrix(table.filter(pa.array(asks)))
        found = search(ids, own, query_ids, queries) if len(ids) and len(query_ids) else ([], [], [])
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.int64() if kind == "long" else pa.float64())})

    found = left.unionByName(right).groupBy("dim", "rb", "qb").applyInArrow(run, SCHEMA.format(kind))
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc()))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]
