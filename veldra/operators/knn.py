"""Nearest-neighbour operators: scans, top-k aggregates, joins and their macro forms.

Exact by default.  One query is an expression and a limit, which Catalyst runs as TakeOrderedAndProject after
pushing filters and columns into the scan.  Joins run as blocks: Arrow batches of both sides meet in NumPy
(``nearest.py``).  A small inner side (its size is checked) is broadcast; beyond that both sides are dealt into a grid
of bounded blocks, one task per block of the grid returns its best k per outer row, and a window with a partial group
limit merges them.  Neither path makes the cross product as rows.

Ties go to the smaller key.  Distances sort numbers, then NaN, then null (a null or missing vector), as plain SQL
with NULLS LAST would.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.metrics import RANKINGS, constant_distance, distance, exact_pairs  # noqa: F401
from ..plans import messages
from .nearest import Candidates

#: An inner side of at most so many bytes is broadcast.
BROADCAST_BYTES, BLOCK_ROWS = 32 << 20, 4096
#: Beyond that a side has blocks of LEAST_ROWS rows or more: up to SIDE of them, or up to GRID where WAVES tasks a core
#: take so many, and more only where they would hold over BLOCK_BYTES of vectors.  A row is sent once per block of the
#: other side, however many rows there are, until blocks are full.
SIDE, GRID, WAVES, LEAST_ROWS, BLOCK_BYTES = 6, 16, 3, 16_384, 64 << 20
#: Rows of an answer that leave a worker at once.
ANSWERS = 1 << 18
#: An outer side that is planned to hold less is dealt out before the search.
SMALL_BYTES = 64 << 20
#: Metric names of the join macros: value, and whether large is near.
MACRO_METRICS = {"l2sq": "l2", "l2": "l2", "cosine": "cosine_similarity", "cos": "cosine_similarity", "ip": "inner_product"}


def knn_scan(
    df: DataFrame, column: str, query, k: int, key: str, metric: str = "l2", where: Column | str | None = None, offset: int = 0, columns: list[str] | None = None,
    name: str = "dist", post_filter: bool = False,
) -> DataFrame:
    """The k rows nearest to a constant vector, nearest first.  ``where`` filters before the limit, or with
    ``post_filter`` after it.  ``columns`` may leave out the distance or name it anywhere."""
    if k < 0 or offset < 0:
        raise ValueError("k and offset must not be negative")
    ranking = RANKINGS[metric]
    rows = df if where is None or post_filter else df.where(where)
    value = constant_distance(ranking.value, column, list(query))
    rows = rows.withColumn(name, value)
    order = F.col(name).desc_nulls_last() if ranking.descending else F.col(name).asc_nulls_last()
    rows = rows.orderBy(order, F.col(key)).offset(offset).limit(k) if offset else rows.orderBy(order, F.col(key)).limit(k)
    if where is not None and post_filter:
        rows = rows.where(where)
    return rows.select(*columns) if columns else rows


def best_k(df: DataFrame, value: Column, score: Column, k: int, descending: bool = False, key: str | None = None, where: Column | str | None = None, name: str = "best") -> DataFrame:
    """One row with the list of ``value`` of the k rows of best score; rows with a null value or score don't count.
    The limit comes first, so only k rows reach the aggregate."""
    if not 0 < k < 2048:
        raise ValueError("k must lie between 1 and 2047")
    rows = df if where is None else df.where(where)
    tie = F.col(key) if key else F.lit(0)
    rows = rows.select(value.alias("x"), score.alias("s"), tie.alias("t")).where("x is not null and s is not null")
    top = rows.orderBy(F.col("s").desc() if descending else F.col("s").asc(), "t").limit(k)
    lead = -F.col("s") if descending else F.col("s")
    packed = F.sort_array(F.collect_list(F.struct(lead.alias("s"), "t", "x")))
    return top.agg(F.transform(packed, lambda r: r["x"]).alias(name))


def min_by_k(df: DataFrame, value: Column, score: Column, k: int, **more) -> DataFrame:
    return best_k(df, value, score, k, False, **more)


def max_by_k(df: DataFrame, value: Column, score: Column, k: int, **more) -> DataFrame:
    return best_k(df, value, score, k, True, **more)


def _matrix(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows of doubles, which rows are vectors): null vectors become rows of zeros."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    given = ~np.asarray(values.is_null())
    sizes = np.asarray(values.value_lengths().fill_null(0))
    dims = np.unique(sizes[given])
    if len(dims) > 1:
        raise ValueError("vectors must have the same dimension")
    flat = values.drop_null().flatten()
    if flat.null_count:
        raise ValueError("vectors must not contain NULL")
    out = np.zeros((len(values), int(dims[0]) if len(dims) else 0))
    if len(dims):
        out[given] = np.asarray(flat, np.float64).reshape(-1, int(dims[0]))
    return out, given


def _joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of a block as one: rows of zeros for null vectors, which rows are vectors, keys."""
    dims = {m.shape[1] for m, given, _ in parts if given.any()}
    if len(dims) > 1:
        raise ValueError("vectors must have the same dimension")
    d = dims.pop() if dims else 0
    rows = [m if given.any() else np.zeros((len(m), d)) for m, given, _ in parts]
    return np.concatenate(rows), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])


def knn_pairs(outer: DataFrame, outer_key: str, outer_vec: str, inner: DataFrame, inner_key: str, inner_vec: str, k: int, metric: str = "l2", broadcast_bytes: int = BROADCAST_BYTES, repeated: bool = False) -> DataFrame:
    """(outer key, inner key, rn, dist): the k nearest inner rows of every outer row; keys are whole numbers.  With
    ``repeated`` outer rows of one key have one vector and count once."""
    if not 0 <= k < 2048:
        raise ValueError("k must lie between 0 and 2047")
    left = outer.select(F.col(outer_key).cast("long").alias("o"), F.col(outer_vec).cast("array<double>").alias("ov"))
    right = inner.select(F.col(inner_key).cast("long").alias("i"), F.col(inner_vec).cast("array<double>").alias("iv"))
    schema = "o long, i long, dist double"
    spark = left.sparkSession
    if k == 0:
        return spark.createDataFrame([], "o long, i long, rn long, dist double")
    count = F.count(F.lit(1)).alias("n")
    size = right.agg(count, F.coalesce(F.max(F.size("iv")), F.lit(0)).alias("d")).first()
    least = F.col("dist").desc_nulls_last() if RANKINGS[metric].descending else F.col("dist").asc_nulls_last()
    # NaN sorts above all numbers: with large first it would lead, so it is moved behind them
    order = [F.col("dist").isNull(), F.isnan("dist"), least, F.col("i")]
    asked = left.where("ov is not null")

    def answers(held: Candidates, o_keys: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        # a batch at a time leaves the worker, so that what it holds doesn't grow with k
        for at in range(0, len(q), step := max(1, ANSWERS // k)):
            keys, values, nulls = held.nearest(q[at : at + step])
            rows = np.repeat(o_keys[at : at + step], keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(keys.ravel()), pa.array(values.ravel(), mask=nulls.ravel(), from_pandas=False)], ["o", "i", "dist"])

    if size["n"] * (8 * size["d"] + 8) <= broadcast_bytes:
        if repeated:
            left = left.dropDuplicates(["o"])
            asked = left.where("ov is not null")
        holes = not left.where("ov is null").isEmpty()
        held = right.toArrow()
        x, x_given = _matrix(held.column("iv"))
        shared = spark.sparkContext.broadcast((x, x_given, held.column("i").to_numpy()))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                if batch.num_rows and len(shared.value[2]):
                    held = held or Candidates(metric, *shared.value, k)
                    yield from answers(held, batch.column(0).to_numpy(), _matrix(batch.column(1))[0])

        # a small outer side may be one file and so one task: dealing it out costs little.  A large one stays where it is
        small = int(str(asked._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL_BYTES
        spread = asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o") if small else asked
        found = spread.mapInArrow(scan, schema)
    else:
        hash_of = F.xxhash64("ov")
        none = F.col("ov").isNull()
        kinds = left.groupBy(hash_of.alias("h"), none.alias("none")).count()
        most = max(BLOCK_ROWS, BLOCK_BYTES // (8 * size["d"] + 8))
        busy = max(SIDE, ceil(sqrt(WAVES * spark.sparkContext.defaultParallelism)))
        side = lambda n: max(min(GRID, busy, 1 + n // LEAST_ROWS), -(-n // most))
        # equal vectors meet in one block, which measures them once; of those with many copies each copy goes its own way
        many = F.when(~F.col("none") & (F.col("count") > LEAST_ROWS), F.col("h"))
        total = kinds.agg(F.sum(F.when(~F.col("none"), F.col("count"))).alias("n"), F.coalesce(F.bool_or("none"), F.lit(False)).alias("holes"), F.collect_list(many).alias("many")).first()
        holes, outer_blocks, blocks = total["holes"], side(total["n"] or 0), side(size["n"])
        deal = lambda c, n: F.pmod(c, F.lit(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        spread = F.when(hash_of.isin(total["many"]), F.xxhash64("o")).otherwise(hash_of) if total["many"] else hash_of
        a = asked.select(deal(spread, outer_blocks).alias("ob"), each(blocks).alias("ib"), F.lit(True).alias("asks"), F.col("o").alias("id"), F.col("ov").alias("v"))
        b = right.select(each(outer_blocks).alias("ob"), deal(F.xxhash64("i"), blocks).alias("ib"), F.lit(False).alias("asks"), F.col("i").alias("id"), F.col("iv").alias("v"))
        dealt = a.unionByName(b).select((F.col("ob") * blocks + F.col("ib")).alias("block"), "asks", "id", "v")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[int, tuple[list, list]] = {}
            for batch in batches:
                block, asks = batch.column("block").to_numpy(), np.asarray(batch.column("asks"))
                for one in np.unique(block).tolist():
                    for mine in (True, False):
                        rows = batch.filter(pa.array((block == one) & (asks == mine)))
                        if rows.num_rows:
                            parts.setdefault(one, ([], []))[not mine].append((*_matrix(rows.column("v")), rows.column("id").to_numpy()))
            while parts:
                mine, theirs = parts.popitem()[1]
                if mine and theirs:
                    (q, _, o_keys), (x, x_given, x_keys) = _joined(mine), _joined(theirs)
                    mine.clear(), theirs.clear()
                    if repeated:
                        # rows of one key have one vector, and so one block
                        first = np.unique(o_keys, return_index=True)[1]
                        q, o_keys = q[first], o_keys[first]
                    yield from answers(Candidates(metric, x, x_given, x_keys, k), o_keys, q)

        # one block, one task: nothing is sorted, and no two blocks share a partition by chance
        found = dealt.repartitionById(outer_blocks * blocks, F.col("block")).mapInArrow(meet, schema)
    if holes:
        # a null vector is equally far from all: the smallest keys
        first = right.select("i").orderBy("i").limit(k)
        lost = left.where("ov is null").select("o")
        found = found.unionByName((lost.distinct() if repeated else lost).crossJoin(F.broadcast(first)).withColumn("dist", F.lit(None).cast("double")))
    ranked = found.withColumn("rn", F.row_number().over(W.partitionBy("o").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rn") <= k).select("o", "i", "rn", "dist")


def _asked(outer: DataFrame, key: str, column: str) -> DataFrame:
    """``outer`` with ``__o``, which stands for its key and vector."""
    return outer.withColumn("__o", F.xxhash64(F.col(key).cast("string"), F.col(column)))


def knn_join(outer: DataFrame, outer_key: str, outer_vec: str, inner: DataFrame, inner_key: str, inner_vec: str, k: int, metric: str = "l2", **more) -> DataFrame:
    """Inner columns, rn, outer columns and dist of the k nearest inner rows of every outer row (a lateral join).

    Outer rows are told apart by a 64-bit hash of key and vector, so keys may repeat, be null or be no numbers.
    """
    clash = set(outer.columns) & set(inner.columns)
    if clash:
        raise ValueError(f"both sides have columns named {sorted(clash)}")
    asked = _asked(outer, outer_key, outer_vec)
    pairs = knn_pairs(asked, "__o", outer_vec, inner, inner_key, inner_vec, k, metric, repeated=True, **more)
    joined = pairs.join(inner, F.col("i") == F.col(inner_key)).join(asked, F.col("o") == F.col("__o"))
    return joined.select(*inner.columns, "rn", *outer.columns, "dist")


def _macro(metric: str) -> str:
    if metric not in MACRO_METRICS:
        raise ValueError(messages.METRIC_UNKNOWN)
    return MACRO_METRICS[metric]


def _scored(left: DataFrame, right: DataFrame, left_key: str, left_col: str, right_key: str, right_col: str, k: int, metric: str) -> DataFrame:
    if "score" in right.columns:
        raise ValueError("the right table must not have a column named score")
    pairs = knn_pairs(_asked(left, left_key, left_col), "__o", left_col, right, right_key, right_col, k, _macro(metric), repeated=True)
    # a score that is null never enters a min_by or max_by list
    return pairs.where("dist is not null")


def vss_join(left: DataFrame, right: DataFrame, left_key: str, left_col: str, right_key: str, right_col: str, k: int, metric: str = "l2sq") -> DataFrame:
    """(score, left_tbl, right_tbl) of the k best right rows of every left row."""
    pairs = _scored(left, right, left_key, left_col, right_key, right_col, k, metric)
    a = _asked(left, left_key, left_col).select(F.col("__o").alias("o"), F.struct(*left.columns).alias("left_tbl"))
    b = right.select(F.col(right_key).alias("i"), F.struct(*right.columns).alias("right_tbl"))
    return pairs.join(b, "i").join(a, "o").select(F.col("dist").alias("score"), "left_tbl", "right_tbl")


def vss_match(left: DataFrame, right: DataFrame, left_key: str, left_col: str, right_key: str, right_col: str, k: int, metric: str = "l2sq") -> DataFrame:
    """Left columns and ``matches``, the list of (score, row) of the k best right rows, best first."""
    pairs = _scored(left, right, left_key, left_col, right_key, right_col, k, metric)
    b = right.select(F.col(right_key).alias("i"), F.struct(*right.columns).alias("row"))
    entry = F.struct("rn", F.col("dist").alias("score"), "row")
    lists = pairs.join(b, "i").groupBy("o").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda m: F.struct(m["score"], m["row"])).alias("matches"))
    return _asked(left, left_key, left_col).join(lists, F.col("__o") == F.col("o"), "left").select(*left.columns, "matches")


def knn_lists(outer: DataFrame, outer_key: str, outer_vec: str, inner: DataFrame, inner_key: str, inner_vec: str, k: int, metric: str = "l2") -> DataFrame:
    """(outer key, list of inner keys, nearest first)."""
    pairs = knn_pairs(outer, outer_key, outer_vec, inner, inner_key, inner_vec, k, metric)
    return pairs.groupBy(F.col("o").alias(outer_key)).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "i"))), lambda m: m["i"]).alias("neighbours"))


def within(df: DataFrame, column: str, query, radius: float, key: str, metric: str = "l2", name: str = "dist") -> DataFrame:
    """Rows no farther than ``radius``."""
    return df.withColumn(name, distance(metric, F.col(column), list(query))).where(F.col(name) <= radius)
