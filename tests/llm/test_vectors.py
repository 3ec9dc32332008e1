"""Recall of the collision counting and equality of the exact search, against brute force."""

import numpy as np
import pytest

from veldra.llm import ann, exact_topk


def table(spark, seed=1, n=700, dim=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * rng.uniform(0.2, 2.0, size=(n, 1))
    x[40:80] = x[40]
    rows = [(i, v.tolist(), "q") for i, v in enumerate(x)]
    rows += [(None, x[0].tolist(), "q"), (n, None, None), (n + 1, [], None), (n + 2, [0.0] * dim, None), (n + 3, [None] + [1.0] * (dim - 1), None),
             (n + 4, [float("nan")] * dim, None), (n + 5, [float("inf")] * dim, None), (n + 6, [1.0, 2.0], None), rows[3]]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string")


def test_recall_ties_and_scores(spark):
    x, df = table(spark)
    got = {}
    for r in ann.neighbours(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 700, 20))
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21))
        scores = x @ x[q]
        assert np.allclose([r[2] for r in rows], scores[[r[1] for r in rows]])
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1])) and all(r[1] != q for r in rows)
        order = [i for i in np.lexsort((np.arange(700), -np.round(scores, 9))) if i != q][:20]
        hits += len({r[1] for r in rows} & set(order))
    assert hits >= 0.9 * 20 * len(got)


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_exact_search(spark, scale):
    x, df = table(spark, 2)
    df = df.selectExpr("vec_id", f"transform(embedding, v -> v * {scale}D) as embedding")
    y = [[int(v) for v in r] for r in np.floor(256 * (x * scale))]
    zero = 702
    got = {}
    for r in exact_topk.nearest(df, scale=256).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 700, 50):
        want = sorted(((-sum(a * b for a, b in zip(y[q], v, strict=True)), i) for i, v in enumerate([*y, [0] * 24]) if i != q))[:5]
        assert [(-s, i if i < 700 else zero) for s, i in want] == [(s, i) for _, i, s in sorted(got[q])]


def test_empty_and_small(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.neighbours(empty).count() == 0 and exact_topk.nearest(empty).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in ann.neighbours(few).orderBy("rank").collect()] == [(1, 0.5), (2, -1.0)]
    assert [(r["vec_id"], r["score"]) for r in exact_topk.nearest(few).orderBy("rank").collect()] == [(1, 128 * 256), (2, -(256**2))]


def test_large_random_recall():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(8000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = np.arange(0, 8000, 200)
    found_q, found_v, _ = ann.search(np.arange(8000), x, q, x[q], 20)
    scores = x[q] @ x.T
    scores[np.arange(len(q)), q] = -9
    best = np.argsort(-scores, axis=1)[:, :20]
    found = {(a, b) for a, b in zip(found_q.tolist(), found_v.tolist(), strict=True)}
    assert sum((int(a), int(b)) in found for a, row in zip(q, best, strict=True) for b in row) >= 0.9 * best.size


@pytest.mark.parametrize("norms", ["one of 3", "one of 10", "gamma", "lognormal"])
def test_recall_with_skewed_norms(norms):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(8192, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms.startswith("one of "):
        x[5] *= float(norms[7:])
    else:
        x *= rng.gamma(2, size=(8192, 1)) if norms == "gamma" else rng.lognormal(0, 0.3, size=(8192, 1))
    q = np.arange(0, 8192, 256)
    found_q, found_v, _ = ann.search(np.arange(8192), x, q, x[q], 20)
    scores = x[q] @ x.T
    scores[np.arange(len(q)), q] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :20]
    found = set(zip(found_q.tolist(), found_v.tolist(), strict=True))
    assert sum((int(a), int(b)) in found for a, row in zip(q, best, strict=True) for b in row) >= 0.95 * best.size


@pytest.mark.parametrize("kind,most", [("skewed", 0.6), ("even", 1.0), ("sparse", 1.0)])
def test_impact_order_stops_on_proof(kind, most):
    """The members hold every true neighbour, and where impacts differ a good part of the postings is never touched."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 48))
    if kind == "skewed":
        x = np.sign(x) * np.abs(x) ** 4 * rng.pareto(1.5, size=(4000, 1))
    if kind == "sparse":
        x[rng.random(x.shape) < 0.9] = 0
    x = np.floor(256 * x)
    index, touched = exact_topk.ImpactIndex(x), 0
    assert index.postings == np.count_nonzero(x)
    for q in range(0, 4000, 200):
        members, seen = index.members(x[q], np.array([q]), 5)
        touched += seen
        scores = x @ x[q]
        scores[q] = -np.inf
        assert set(np.flatnonzero(scores >= np.sort(scores)[-5])) <= set(members.tolist())
        assert len(members) <= 5 + exact_topk.FEW or seen <= index.postings
    assert 0 < touched <= most * 20 * index.postings


def test_scores_outside_64_bits_are_the_nearest(spark):
    df = spark.createDataFrame([(0, [1e9, 1e9]), (1, [1e9, 1e9]), (2, [-1e9, -1e9]), (3, [2e9, 1e9])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in exact_topk.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(1, 2**63 - 1), (3, 2**63 - 1), (2, -(2**63))]
