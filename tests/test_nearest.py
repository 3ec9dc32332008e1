"""The nearest-neighbour kernel against plain measuring of all pairs, and the join's paths on awkward vectors."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldra.functions.metrics import RANKINGS, exact_pairs
from veldra.operators import knn, nearest

METRICS = ["l2", "cosine_distance", "negative_inner_product", "cosine_similarity", "inner_product"]


def brute(metric, q, x, given, keys, k):
    sign = -1 if RANKINGS[metric].descending else 1
    for row in q:
        value = exact_pairs(metric, np.broadcast_to(row, x.shape), x)
        none = np.where(given, np.isnan(value).astype(int), 2)
        order = np.lexsort((keys, np.where(none > 0, 0, sign * value), none))[:k]
        yield keys[order], np.where(given[order], value[order], np.nan), ~given[order]


def awkward(rng, n, d):
    x = rng.normal(size=(n, d)) * rng.choice([1.0, 2.0, 5.0, 1e-9, 1e9], size=(n, 1))
    x[rng.random(n) < 0.1] = 0
    x[rng.random(n) < 0.2] = x[0]
    near = rng.random(n) < 0.2
    x[near] = x[1] + 1e-9 * rng.normal(size=(near.sum(), d))
    x[2, 0], x[3, 1], x[4, 0], x[5], x[6] = np.nan, np.inf, -np.inf, 1e200, 1e-200
    x[7, 0], x[8, 0] = np.inf, 1e155
    return x


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("k", [1, 3, 40, 700])
@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_kernel_agrees_with_all_pairs(metric, k, monkeypatch):
    monkeypatch.setattr(nearest, "TILE", 1 << 13)
    monkeypatch.setattr(nearest, "HELD", 300)
    rng = np.random.default_rng(k)
    for d in (2, 7):
        x, q = awkward(rng, 600, d), awkward(rng, 60, d)
        keys, given = rng.permutation(600), rng.random(600) > 0.1
        held = nearest.Candidates(metric, np.where(given[:, None], x, 0), given, keys, k)
        held.width, held.height = 64 if k < 64 else held.width, 16
        for got, want in zip(zip(*held.nearest(q), strict=True), brute(metric, q, x, given, keys, k), strict=True):
            assert got[0].tolist() == want[0].tolist() and got[2].tolist() == want[2].tolist()
            np.testing.assert_array_equal(got[1], want[1])


def test_like_vectors_are_measured_once_and_memory_stays_bounded(monkeypatch):
    """4,000 queries and 30,000 candidates of 3 different vectors: 1.2e8 ties, of which k a query are measured."""
    seen = []
    real = nearest.exact_pairs
    monkeypatch.setattr(nearest, "exact_pairs", lambda metric, q, x: seen.append(len(q)) or real(metric, q, x))
    x = np.eye(3)[np.arange(30_000) % 3]
    held = nearest.Candidates("l2", x, np.ones(30_000, bool), np.arange(30_000), 2)
    keys, values, _ = held.nearest(x[:4000])
    assert (keys == (np.arange(4000) % 3)[:, None] + [0, 3]).all() and not values.any() and sum(seen) < 100


def test_tiles_that_promise_most_come_first(monkeypatch):
    """Where short vectors are the nearest to long ones, tiles in the order of lengths brought over 100 pairs a query."""
    kept = []
    real = np.flatnonzero
    monkeypatch.setattr(np, "flatnonzero", lambda m: kept.append(len(found := real(m)) * (np.ndim(m) == 2)) or found)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20_000, 64))
    x *= (1 + np.arange(20_000) % 5)[:, None] / np.linalg.norm(x, axis=1)[:, None]
    held = nearest.Candidates("l2", x, np.ones(20_000, bool), np.arange(20_000), 3)
    keys, values, _ = held.nearest(x[:500])
    assert (keys[:, 0] == np.arange(500)).all() and not values[:, 0].any() and sum(kept) < 30 * 500
    for got, want in zip(keys[:20], brute("l2", x[:20], x, np.ones(20_000, bool), np.arange(20_000), 3), strict=True):
        assert got.tolist() == want[0].tolist()


def test_only_rows_with_a_near_candidate_are_looked_through(monkeypatch):
    """Every score of every tile was compared with the bounds of its query and searched: 1e7 here, now less than a third."""
    seen = []
    real = np.flatnonzero
    monkeypatch.setattr(np, "flatnonzero", lambda m: seen.append(np.size(m)) or real(m))
    x = np.random.default_rng(6).normal(size=(20_000, 64))
    held = nearest.Candidates("cosine_similarity", x, np.ones(20_000, bool), np.arange(20_000), 1)
    keys, _, _ = held.nearest(x[:500] + 0.01)
    assert (keys[:, 0] == np.arange(500)).all() and sum(seen) < 500 * 20_000 // 3


def test_grid_sends_a_row_no_oftener_as_tables_grow(spark, monkeypatch):
    """The rows dealt to blocks grow with the table, not with its square; equal outer vectors meet in one block."""
    monkeypatch.setattr(knn, "GRID", 3)
    monkeypatch.setattr(knn, "LEAST_ROWS", 50)
    for n in (300, 1200):
        df = spark.range(n).select("id", F.array((F.col("id") % 97).cast("double"), (F.col("id") % 89).cast("double")).alias("v"))
        got = knn.knn_pairs(df, "id", "v", df, "id", "v", 2, broadcast_bytes=0)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert re.findall(r"RepartitionByExpression .*, (\d+)\n", plan) == ["9"] and got.count() == 2 * n


@pytest.mark.parametrize("bytes_", [1 << 20, 0])
@pytest.mark.parametrize("metric", METRICS)
def test_join_of_null_repeated_and_zero_vectors(spark, metric, bytes_, monkeypatch):
    monkeypatch.setattr(knn, "LEAST_ROWS", 20)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 3)).astype(np.float32).astype(float)
    x[10:60], x[60:70] = x[10], 0
    given = np.arange(150) % 7 != 0
    df = spark.createDataFrame([(i, v.tolist() if g else None) for i, (v, g) in enumerate(zip(x, given, strict=True))], "i long, v array<double>")
    want = {}
    for o, (keys, values, nulls) in enumerate(brute(metric, x, x, given, np.arange(150), 4)):
        rows = [(int(i), None if n else float(v)) for i, v, n in zip(keys, values, nulls, strict=True)] if given[o] else [(i, None) for i in range(4)]
        want |= {(o, rn + 1): r for rn, r in enumerate(rows)}
    got = {(r["o"], r["rn"]): (r["i"], r["dist"]) for r in knn.knn_pairs(df, "i", "v", df, "i", "v", 4, metric, broadcast_bytes=bytes_).collect()}
    assert repr(sorted(got.items())) == repr(sorted(want.items()))


def test_grid_is_no_finer_than_the_cores_take(spark, monkeypatch):
    """16 by 16 blocks sent every row 16 times where 6 by 6 keep the cores busy; full blocks still make more."""
    monkeypatch.setattr(knn, "LEAST_ROWS", 10)
    df = spark.range(2000).select("id", F.array((F.col("id") % 97).cast("double"), (F.col("id") % 89).cast("double")).alias("v"))

    def tasks() -> list[str]:
        plan = knn.knn_pairs(df, "id", "v", df, "id", "v", 2, broadcast_bytes=0)._jdf.queryExecution().optimizedPlan().toString()
        return re.findall(r"RepartitionByExpression .*, (\d+)\n", plan)

    assert tasks() == ["36"]
    monkeypatch.setattr(knn, "BLOCK_ROWS", 100)
    monkeypatch.setattr(knn, "BLOCK_BYTES", 1)
    assert tasks() == ["400"]


@pytest.mark.parametrize("many", [10, 16_384])
def test_repeated_outer_rows_are_found_in_blocks_without_sending_their_vectors_before(spark, many, monkeypatch):
    """Outer rows were told apart by an exchange of whole vectors ahead of the blocks, once for each job of a join."""
    monkeypatch.setattr(knn, "LEAST_ROWS", many)
    inner = spark.range(200).select(F.col("id").alias("item"), F.array((F.col("id") % 13).cast("double"), (F.col("id") % 7).cast("double")).alias("bv"))
    some = inner.select((F.col("item") % 50).alias("asked"), F.when(F.col("item") % 9 > 0, F.col("bv")).alias("av"))
    outer = some.unionByName(some.where("asked < 20")).unionByName(some.select(F.lit(None).cast("long").alias("asked"), "av"))
    got = [knn.knn_join(outer, "asked", "av", inner, "item", "bv", 3, broadcast_bytes=size) for size in (1 << 20, 0)]
    rows = [sorted(map(repr, df.collect())) for df in got]
    assert rows[0] == rows[1] and len(rows[0]) == 3 * outer.count()
    plan = got[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "first(av" not in plan
