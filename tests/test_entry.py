"""Every catalogue query at the smallest scale, and some of them against NumPy."""

import numpy as np
import pytest

import __spark_entry__ as entry
from veldra import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_runs(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    assert len(rows) > 0 and len(set(df.columns)) == len(df.columns)


def test_metrics_equal_numpy(spark):
    rows = catalogue.scaled(spark, SF).orderBy("vec_id").collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    q = v[0]
    want = {"metric_l2": np.linalg.norm(v - q, axis=1), "metric_ip": v @ q, "metric_cos_sim": v @ q / np.linalg.norm(v, axis=1) / np.linalg.norm(q)}
    for name, values in want.items():
        got = {r["vec_id"]: r["value"] for r in catalogue.QUERIES[name](spark, SF).collect()}
        assert len(got) == len(ids) and np.allclose([got[i] for i in ids.tolist()], values, atol=2e-5), name


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.QUERIES) <= set(entry.queries())
