"""Operators over whole vector sets: group distances, clustering, and one-to-one matching."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.metrics import distance, exact_pairs
from ..plans import messages
from ..sources.files import working_dir
from .knn import BLOCK_ROWS, knn_pairs


def group_distance_stats(left: DataFrame, left_vec: str, right: DataFrame, right_vec: str, metric: str = "l2") -> DataFrame:
    """(pairs, mean_dist, min_dist, max_dist) of the distances between two groups.

    The groups meet in blocks of bounded size; a block returns four numbers, and no pair becomes a row.
    """
    a, b = left.select(F.col(left_vec).cast("array<double>").alias("v")).where("v is not null"), right.select(F.col(right_vec).cast("array<double>").alias("v")).where("v is not null")
    blocks = [1 + side.count() // BLOCK_ROWS for side in (a, b)]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("v"), F.lit(n)).cast("int")
    sides = a.select(deal(blocks[0]).alias("x"), each(blocks[1]).alias("y"), F.lit(True).alias("first"), "v").unionByName(b.select(each(blocks[0]).alias("x"), deal(blocks[1]).alias("y"), F.lit(False).alias("first"), "v"))

    def meet(table: pa.Table) -> pa.Table:
        first = table.column("first")
        one, two = (np.array(t.column("v").to_pylist(), float) for t in (table.filter(first), table.filter(pa.compute.invert(first))))
        parts = [exact_pairs(metric, np.broadcast_to(row, two.shape), two) for row in one] if len(one) and len(two) else []
        rows = [(len(p), float(p.sum()), float(p.min()), float(p.max())) for p in parts]
        return pa.Table.from_pylist([dict(zip(("n", "s", "lo", "hi"), r, strict=True)) for r in rows], schema=pa.schema([("n", pa.int64()), ("s", pa.float64()), ("lo", pa.float64()), ("hi", pa.float64())]))

    found = sides.groupBy("x", "y").applyInArrow(meet, "n long, s double, lo double, hi double")
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    return found.agg(total.alias("pairs"), (F.sum("s") / F.when(total > 0, total)).alias("mean_dist"), F.min("lo").alias("min_dist"), F.max("hi").alias("max_dist"))


def cluster(vectors: DataFrame, key: str, column: str, level_share: int = 16, max_clusters: int | None = None, metric: str = "l2") -> DataFrame:
    """(key, centroid, dist): every vector goes to the nearest centroid.  Centroids are the keys for which
    (key * 2654435761 + 12345) mod ``level_share`` is 0, a stand-in for the nodes on the upper levels of a graph (with
    the default 16 these are the keys congruent to 7); if none are, too few to cluster is reported.  Beyond ``max_clusters`` the smallest cluster is merged
    into its nearest neighbour until few enough are left: a loop over centroids, of which there are few."""
    rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(column).alias("v")).where("v is not null")
    if rows.isEmpty():
        raise ValueError(messages.NO_CLUSTERS)
    centroids = rows.where(F.pmod(F.col("k") * 2654435761 + 12345, F.lit(level_share)) == 0)
    if centroids.isEmpty():
        raise ValueError(messages.TOO_SMALL)
    own = centroids.select(F.col("k").alias("ck"), F.col("v").alias("cv"))
    near = knn_pairs(rows, "k", "v", own, "ck", "cv", 1, metric).select(F.col("o").alias("k"), F.col("i").alias("c"), "dist")
    if max_clusters is not None and max_clusters > 0:
        sizes = {r["c"]: r["count"] for r in near.groupBy("c").count().collect()}
        if len(sizes) > max_clusters:
            points = {r["ck"]: r["cv"] for r in own.collect()}
            target = {c: c for c in sizes}
            live = dict(sizes)
            while len(live) > max_clusters:
                small = min(live, key=lambda c: (live[c], c))
                rest = [c for c in live if c != small]
                goal = min(rest, key=lambda c: (math.dist(points[small], points[c]), c))
                live[goal] += live.pop(small)
                target = {c: goal if t == small else t for c, t in target.items()}
            moves = near.sparkSession.createDataFrame(list(target.items()), "c long, t long")
            moved = near.join(F.broadcast(moves), "c").select("k", F.col("t").alias("c"))
            at = own.select(F.col("ck").alias("c"), "cv")
            near = moved.join(at, "c").join(rows, "k").select("k", "c", distance(metric, F.col("v"), F.col("cv")).alias("dist"))
    return near.select(F.col("k").alias(key), F.col("c").alias("centroid"), "dist")


def match_one_to_one(men: DataFrame, man_key: str, man_vec: str, women: DataFrame, woman_key: str, woman_vec: str, metric: str = "l2", candidates: int = 16) -> DataFrame:
    """(man, woman, dist): the stable one-to-one matching; ties go to the smaller keys.

    Both sides rank by one symmetric distance, so the matching is the one that takes the closest free pair again and
    again.  Each round takes all pairs that are each other's best at once.  Everyone keeps a list of the
    ``candidates`` nearest of the other side; the first free entry of a list is its owner's true best, so short lists
    lose nothing.  When no pair is left in the lists, those still free get fresh ones.
    """
    if men is women:
        raise ValueError(messages.SELF_JOIN)
    spark = men.sparkSession
    free_m = men.select(F.col(man_key).cast("long").alias("m"), F.col(man_vec).alias("mv")).where("mv is not null")
    free_w = women.select(F.col(woman_key).cast("long").alias("w"), F.col(woman_vec).alias("wv")).where("wv is not null")
    folder, turn = f"{working_dir(spark)}/match-{uuid.uuid4().hex}", 0

    def keep(df: DataFrame) -> DataFrame:
        nonlocal turn
        turn += 1
        df.write.parquet(f"{folder}/{turn}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{turn}")

    done: list[DataFrame] = []
    while not free_m.isEmpty() and not free_w.isEmpty():
        by_m = knn_pairs(free_m, "m", "mv", free_w, "w", "wv", candidates, metric).select(F.col("o").alias("m"), F.col("i").alias("w"), "dist")
        by_w = knn_pairs(free_w, "w", "wv", free_m, "m", "mv", candidates, metric).select(F.col("i").alias("m"), F.col("o").alias("w"), "dist")
        by_m, by_w, got = keep(by_m), keep(by_w), []
        while True:
            first_m = by_m.groupBy("m").agg(F.min(F.struct("dist", "w")).alias("b")).select("m", F.col("b.w").alias("w"), F.col("b.dist").alias("dist"))
            first_w = by_w.groupBy("w").agg(F.min(F.struct("dist", "m")).alias("b")).select(F.col("b.m").alias("m"), "w")
            taken = keep(first_m.join(first_w, ["m", "w"]))
            if taken.isEmpty():
                break
            got.append(taken)
            rest = lambda pairs: pairs.join(taken.select("m"), "m", "left_anti").join(taken.select("w"), "w", "left_anti").select("m", "w", "dist")  # noqa: B023, E731
            by_m, by_w = keep(rest(by_m)), keep(rest(by_w))
        for taken in got:
            free_m, free_w = free_m.join(taken.select("m"), "m", "left_anti"), free_w.join(taken.select("w"), "w", "left_anti")
        free_m, free_w, done = keep(free_m), keep(free_w), done + got
    out = spark.createDataFrame([], "m long, w long, dist double")
    for taken in done:
        out = out.unionByName(taken)
    return out.select(F.col("m").alias("man"), F.col("w").alias("woman"), "dist")
