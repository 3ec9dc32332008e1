"""Metrics against NumPy, their null and zero rules, and both lowerings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldra.functions import metrics as M
from veldra.functions import vector as V


def values(spark, metric, a, b, dim):
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)], "a array<double>, b array<double>")
    return np.array([r[0] for r in df.select(M.distance(metric, F.col("a"), F.col("b"), dim)).collect()])


def want(metric, a, b):
    dot, na, nb = (a * b).sum(1), np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    cosine = dot / (na * nb)
    mid = (a + b) / 2 + M.EPSILON
    return {
        "l2": np.sqrt(((a - b) ** 2).sum(1)), "l2sq": ((a - b) ** 2).sum(1), "inner_product": dot, "negative_inner_product": -dot, "ip": 1 - dot,
        "cosine_similarity": cosine, "cosine_distance": 1 - cosine, "cosine": 1 - cosine, "pearson": 1 - np.array([np.corrcoef(x, y)[0, 1] for x, y in zip(a, b, strict=True)]),
        "divergence": (a * np.log((a + M.EPSILON) / mid) + b * np.log((b + M.EPSILON) / mid)).sum(1) / 2, "kullback_leibler": (a * np.log((a + M.EPSILON) / (b + M.EPSILON))).sum(1),
    }[metric]


@pytest.mark.parametrize("dim", [None, 12])
@pytest.mark.parametrize("metric", ["l2", "l2sq", "inner_product", "negative_inner_product", "ip", "cosine_similarity", "cosine_distance", "cosine", "pearson", "divergence", "kullback_leibler"])
def test_dense_metrics(spark, metric, dim):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(0.1, 1, (20, 12)), rng.uniform(0.1, 1, (20, 12))
    assert np.allclose(values(spark, metric, a, b, dim), want(metric, a, b))


def test_constant_vector_equals_column(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0],), ([0.0, 0.0, 0.0],), (None,)], "v array<float>")
    got = df.select(M.distance("l2", F.col("v"), [1.0, 2.0, 4.0]), M.distance("cosine_distance", F.col("v"), [1.0, 2.0, 4.0]), M.distance("cosine", F.col("v"), [1.0, 2.0, 4.0])).collect()
    assert got[0][0] == 2.0 and math.isnan(got[1][1]) and got[1][2] == 1.0 and got[2][0] is None


@pytest.mark.parametrize("dim", [None, 2])
@pytest.mark.parametrize("a,b,text", [([1.0, 2.0], [1.0], "same dimension"), ([1.0, None], [1.0, 2.0], "NULL")])
def test_wrong_vectors(spark, a, b, text, dim):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    with pytest.raises(Exception, match=text):
        df.select(M.distance("l2", F.col("a"), F.col("b"), dim)).collect()


def test_zero_vectors(spark):
    zero, one = np.zeros((1, 3)), np.ones((1, 3))
    assert math.isnan(values(spark, "cosine_similarity", zero, one, 3)[0])
    assert values(spark, "cosine", zero, one, 3)[0] == 1 and values(spark, "cosine", zero, zero, 3)[0] == 0
    assert values(spark, "pearson", one, one, 3)[0] == 0


def test_bits_bytes_and_sets(spark):
    rng = np.random.default_rng(2)
    rows = [(rng.normal(size=70).tolist(), rng.normal(size=70).tolist()) for _ in range(10)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    a, b = M.to_bits(F.col("a")), M.to_bits(F.col("b"))
    got = df.select(M.hamming(a, b), M.tanimoto(a, b), M.sorensen(a, b), M.from_bits(a, 70), M.to_i8(F.col("a"))).collect()
    for (x, y), r in zip(rows, got, strict=True):
        x, y = np.array(x) > 0, np.array(y) > 0
        assert r[0] == (x != y).sum() and math.isclose(r[1], 1 - (x & y).sum() / (x | y).sum()) and math.isclose(r[2], 1 - 2 * (x & y).sum() / (x.sum() + y.sum()))
        assert r[3] == x.astype(float).tolist()
    assert all(-100 <= v <= 100 for r in got for v in r[4])
    sets = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], [])], "a array<int>, b array<int>")
    assert [r[0] for r in sets.select(M.jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0]


def test_names_and_own_metrics(spark):
    assert M.canonical("COS") == "cosine" and M.canonical("inner") == "ip" and M.canonical("euclidean_sq") == "l2sq"
    with pytest.raises(ValueError, match="Unknown metric"):
        M.canonical("nope")
    df = spark.createDataFrame([([1.0],)], "v array<double>")
    assert df.select(M.distance(lambda a, b: a[0] + b[0], F.col("v"), F.col("v"))).first()[0] == 2.0


def test_sql_functions(spark):
    V.register(spark)
    row = spark.sql("SELECT array_distance(array(1D,2D,3D), array(1D,2D,5D)), array_inner_product(array(1D,2D), array(3D,4D)), array_cosine_distance(array(0D), array(1D)), array_distance(NULL, array(1D))").first()
    assert row[0] == 2.0 and row[1] == 11.0 and math.isnan(row[2]) and row[3] is None
