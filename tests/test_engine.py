"""The reference's logic tests, restated: top-k, joins, macros, index life cycle, options, restarts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldra.engine import VectorEngine
from veldra.operators import bulk, knn
from veldra.operators.graph import Graph, distances
from veldra.plans import messages
from veldra.plans.options import IndexError_, IndexOptions
from veldra.plans.rewrite import rewrite_expression, run_sql


@pytest.fixture(scope="module")
def grid(spark):
    i = F.col("id")
    return spark.range(729).select("id", F.array(1 + i % 9, 1 + F.floor(i / 9) % 9, 1 + F.floor(i / 81)).cast("array<float>").alias("vec")).cache()


def test_top_k_on_the_grid(grid):
    assert [r["dist"] for r in knn.knn_scan(grid, "vec", [1, 2, 3], 3, "id").collect()] == [0.0, 1.0, 1.0]
    best = knn.min_by_k(grid, F.col("vec"), knn.distance("l2", F.col("vec"), [5.0, 5.0, 5.0]), 3, key="id").first()["best"]
    assert 43 <= sum(map(sum, best)) <= 47 and len(best) == 3  # the centre and two neighbours one step away
    assert knn.knn_scan(grid, "vec", [1, 2, 3], 0, "id").count() == 0
    plan = knn.knn_scan(grid, "vec", [1, 2, 3], 3, "id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_projections_of_the_scan(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [4.0, 5.0, 6.0])], "id int, vec array<float>")
    for columns in (["id"], ["vec"], ["id", "vec"], ["vec", "id"], ["dist"], ["dist", "id", "vec"]):
        assert knn.knn_scan(df, "vec", [1, 2, 3], 1, "id", columns=columns).columns == columns


def test_macros_on_the_grid(spark, grid):
    probes = spark.createDataFrame([(0, [5.0, 5.0, 5.0]), (1, [1.0, 1.0, 1.0])], "pid int, pv array<float>")
    joined = knn.vss_join(probes, grid, "pid", "pv", "id", "vec", 3).collect()
    assert len(joined) == 6 and all(r["score"] <= 1 for r in joined) and "score" not in joined[0]["right_tbl"].asDict()
    matched = knn.vss_match(probes, grid, "pid", "pv", "id", "vec", 3).collect()
    assert [len(r["matches"]) for r in matched] == [3, 3]
    with pytest.raises(ValueError, match="Unknown metric"):
        knn.vss_join(probes, grid, "pid", "pv", "id", "vec", 3, "foo")
    with pytest.raises(ValueError, match="score"):
        knn.vss_join(probes, grid.withColumn("score", F.lit(1)), "pid", "pv", "id", "vec", 3)


@pytest.mark.parametrize("bytes_", [1 << 20, 0])
def test_lateral_join_golden_rows(spark, bytes_):
    a = spark.createDataFrame([([1.0, 2.0, 3.0], 1), ([4.0, 5.0, 6.0], 2)], "a_vec array<float>, a_id long")
    b = spark.createDataFrame([(0, [4.0, 5.0, 6.0], "b"), (1, [1.0, 2.0, 3.0], "a")], "b_id long, b_vec array<float>, b_str string")
    got = knn.knn_join(a, "a_id", "a_vec", b, "b_id", "b_vec", 1, broadcast_bytes=bytes_).collect()
    assert sorted((r["a_id"], r["b_str"], r["rn"]) for r in got) == [(1, "a", 1), (2, "b", 1)]
    b = b.unionByName(spark.createDataFrame([(2, None, "none")], b.schema))
    a = a.unionByName(spark.createDataFrame([(None, 3)], a.schema))
    got = knn.knn_join(a, "a_id", "a_vec", b, "b_id", "b_vec", 3, broadcast_bytes=bytes_).collect()
    by = {(r["a_id"], r["rn"]): (r["b_str"], r["dist"]) for r in got}
    assert by[1, 3] == ("none", None) and [by[3, n] for n in (1, 2, 3)] == [("b", None), ("a", None), ("none", None)]
    assert knn.knn_join(a, "a_id", "a_vec", b, "b_id", "b_vec", 0).count() == 0
    twice = a.where("a_id = 1").unionByName(a.where("a_id = 1"))
    assert knn.knn_join(twice, "a_id", "a_vec", b, "b_id", "b_vec", 1, broadcast_bytes=bytes_).count() == 2


@pytest.mark.parametrize("metric", ["l2", "cosine_distance", "negative_inner_product", "cosine_similarity", "inner_product"])
def test_join_paths_agree_with_numpy(spark, metric):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5))
    x[10:20] = x[10]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    values = knn.exact_pairs(metric, np.repeat(x, 300, 0), np.tile(x, (300, 1))).reshape(300, 300)
    sign = -1 if knn.RANKINGS[metric].descending else 1
    want = {(o, n + 1): int(c) for o in range(300) for n, c in enumerate(np.lexsort((np.arange(300), sign * values[o]))[:4])}
    for bytes_ in (1 << 20, 0):
        got = {(r["o"], r["rn"]): r["i"] for r in knn.knn_pairs(df, "i", "v", df, "i", "v", 4, metric, broadcast_bytes=bytes_).collect()}
        assert got == want


def test_sql_lateral_and_rewrites(spark):
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [9.0, 9.0])], "qid long, qv array<double>").createOrReplaceTempView("q_t")
    spark.createDataFrame([(7, [9.0, 8.0]), (8, [1.0, 1.0])], "iid long, iv array<double>").createOrReplaceTempView("i_t")
    rows = run_sql(spark, "SELECT qid, iid FROM q_t, LATERAL (SELECT iid FROM i_t ORDER BY array_distance(i_t.iv, q_t.qv) LIMIT 1) t", {"q_t": "qid", "i_t": "iid"}).collect()
    assert sorted(map(tuple, rows)) == [(1, 8), (2, 7)]
    assert run_sql(spark, "SELECT max(qv <-> qv) AS d FROM q_t", {}).first()["d"] == 0.0
    assert rewrite_expression("1 - array_cosine_similarity(a, b)") == "array_cosine_distance(a, b)"
    assert rewrite_expression("2 - array_cosine_similarity(a, b)") == "2 - array_cosine_similarity(a, b)"
    assert "negative" in rewrite_expression("-array_inner_product(a, b)") and "negative" not in rewrite_expression("x - array_inner_product(a, b)")


def test_options_and_messages(spark):
    assert IndexOptions.parse({"m": 8}).M0 == 16 and IndexOptions.parse({"M": 8, "m0": 5}).M0 == 5 and IndexOptions.parse({"METRIC": "COSINE"}).metric == "cosine"
    empty = spark.createDataFrame([], "id int, vec array<float>, d array<double>, x int")
    engine = VectorEngine(spark)
    for column, text in (("x", "HNSW index keys must be of type FLOAT\\[N\\]"), ("d", "HNSW index key type must be one of: 'FLOAT\\[N\\]'"), (["vec", "d"], "single column of keys")):
        with pytest.raises(IndexError_, match=text):
            engine.create_index("i", empty, column, "id")
    with pytest.raises(IndexError_, match="unique or primary key"):
        engine.create_index("i", empty, "vec", "id", unique=True)
    engine.create_index("i", empty, "vec", "id", metric="cosine", ef_construction=10, ef_search=10, M=10, M0=10)
    assert engine.info().first()["count"] == 0 and engine.search_many("i", empty, "id", "vec", 3).count() == 0
    with pytest.raises(IndexError_, match='Index with name "i" already exists'):
        engine.create_index("i", empty, "vec", "id")
    engine.create_index("i", empty, "vec", "id", if_not_exists=True)
    with pytest.raises(IndexError_, match="Index nope not found"):
        engine.compact("nope")
    twice = spark.createDataFrame([(1, [1.0]), (1, [2.0])], "id int, vec array<float>")
    with pytest.raises(IndexError_, match="Duplicate keys"):
        engine.create_index("j", twice, "vec", "id")


def test_life_cycle_over_restarts(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = lambda *r: spark.createDataFrame(list(r), "id long, vec array<float>")
    with pytest.raises(IndexError_) as error:
        VectorEngine(spark, path).create_index("i", rows(), "vec", "id")
    assert str(error.value) == messages.PERSISTENCE
    conf = {"hnsw_enable_experimental_persistence": True}
    engine = VectorEngine(spark, path, conf)
    engine.create_index("i", rows(), "vec", "id", "t1")
    assert VectorEngine(spark, path, conf).count("i") == 0
    engine.insert("i", rows((1, [1.0, 2.0, 3.0]), (2, [4.0, 5.0, 6.0]), (9, None)))
    engine = VectorEngine(spark, path, conf)
    assert engine.count("i") == 2
    engine.insert("i", rows((3, [7.0, 8.0, 9.0])))
    engine.remove("i", [1])
    engine = VectorEngine(spark, path, conf)
    assert engine.count("i") == 2 and not engine.contains("i", 1) and engine.get("i", 3) == [7.0, 8.0, 9.0]
    asked = rows((0, [1.0, 2.0, 3.0]))
    assert [r["key"] for r in engine.search_many("i", asked, "id", "vec", 5).orderBy("rn").collect()] == [2, 3]
    engine.compact("i")
    assert engine.info().select("count", "capacity").first() == (2, 2)
    engine.insert("i", rows((1, [1.0, 2.0, 3.0])))
    assert [r["key"] for r in engine.search_many("i", asked, "id", "vec", 1).collect()] == [1]
    engine.rename_key("i", 1, 11)
    assert [r["key"] for r in engine.export_keys("i").collect()] == [2, 3, 11]
    engine.drop_index("i")
    assert VectorEngine(spark, path, conf).metas == {}


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
def test_a_beam_that_covers_the_part_is_exact(spark, metric):
    """Near copies in tight groups fill each other's links, and rows that none leads to were never found."""
    rng = np.random.default_rng(9)
    x = (np.repeat(rng.normal(size=(30, 6)), 20, 0) + 1e-3 * rng.normal(size=(600, 6))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>")
    engine = VectorEngine(spark)
    engine.create_index("i", df, "vec", "id", metric=metric, M=4, ef_construction=8)
    engine.remove("i", [0, 7, 599])
    live = df.where("id not in (0, 7, 599)")
    want = knn.knn_pairs(live, "id", "vec", live, "id", "vec", 5, {"l2sq": "l2", "cosine": "cosine_distance", "ip": "negative_inner_product"}[metric])
    got = engine.search_many("i", live, "id", "vec", 5, 300).select("query", "key", "rn")
    assert sorted(map(tuple, got.collect())) == sorted((r["o"], r["i"], r["rn"]) for r in want.collect())


def test_choice_and_silent_fallback(spark, grid):
    engine = VectorEngine(spark)
    for metric in ("l2sq", "cosine", "ip"):
        engine.create_index(f"i_{metric}", grid, "vec", "id", "grid", metric=metric, M=4, ef_construction=16)
    assert engine.describe_plan("grid", "vec", "cosine", 3) == "HNSW_INDEX_SCAN(index=i_cosine, table=grid, limit=3)"
    assert engine.describe_plan("other", "vec", "cosine", 3).startswith("TOP_N")
    near = engine.search(grid, "grid", "vec", "id", [1.0, 2.0, 3.0], 3, mode="ann", ef_search=1000).collect()
    assert [r["dist"] for r in near] == [0.0, 1.0, 1.0]
    assert [r["dist"] for r in engine.search(grid, "none", "vec", "id", [1.0, 2.0, 3.0], 3, mode="ann").collect()] == [0.0, 1.0, 1.0]


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
def test_graph_recall_and_links(metric):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 8))
    graph = Graph.build(np.arange(600), x, metric, 8, 16, 64)
    assert all(len(n) <= 16 for n in graph.links[0].values())
    skip = np.zeros(600, bool)
    skip[::3] = True
    hits = 0
    for q in x[:60]:
        exact = np.argsort(distances(metric, x, q) + np.where(skip, 1e9, 0), kind="stable")[:10]
        found = [s for _, s in graph.search(q, 10, 64, skip)]
        assert not skip[found].any()
        hits += len(set(found) & set(exact.tolist()))
    assert hits >= 0.9 * 600
    again = Graph.load(graph.keys, graph.levels, [[graph.links[lv].get(s, []) for lv in range(graph.levels[s] + 1)] for s in range(600)], x, metric, 8, 16)
    assert again.search(x[5], 5, 64) == graph.search(x[5], 5, 64)


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
def test_many_queries_walk_a_graph_as_one_does(metric, monkeypatch):
    """Distances are asked for whole batches: one by one, 2,000 rows and 200 queries took over 100,000 calls."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 8))
    x[50:60], x[60] = x[50], 0
    calls = []
    one = Graph._far
    monkeypatch.setattr(Graph, "_far", lambda self, slots, query: calls.append(1) or one(self, slots, query))
    graph = Graph.build(np.arange(2000), x, metric, 8, 16, 64)
    together = graph.search_all(x[::10], 10, 64)
    assert len(calls) < 60_000
    for q, slots in zip(x[::10], together, strict=True):
        alone = [s for _, s in graph.search(q, 10, 64)]
        np.testing.assert_allclose(np.sort(distances(metric, x[slots], q)), np.sort(distances(metric, x[alone], q)), atol=1e-9)
    few = Graph.build(np.arange(3), x[:3], metric, 8, 2, 64)
    assert np.sort(few.search_all(x[:2], 5, 8), axis=1).tolist() == [[0, 1, 2, 3, 3]] * 2


def test_bulk_operators(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(70, 4)), rng.normal(size=(90, 4))
    frame = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "k long, v array<double>")
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    free, want = {(i, j) for i in range(70) for j in range(90)}, {}
    for i, j in sorted(free, key=lambda p: (d[p], p)):
        if i not in want and j not in want.values():
            want[i] = j
    got = bulk.match_one_to_one(frame(x), "k", "v", frame(y), "k", "v", candidates=4).collect()
    assert {r["man"]: r["woman"] for r in got} == want
    stats = bulk.group_distance_stats(frame(x), "v", frame(y), "v").first()
    assert stats["pairs"] == d.size and np.isclose(stats["mean_dist"], d.mean()) and np.isclose(stats["max_dist"], d.max())
    clusters = bulk.cluster(frame(x), "k", "v", level_share=4, max_clusters=3).collect()
    assert len(clusters) == 70 and len({r["centroid"] for r in clusters}) == 3
    with pytest.raises(ValueError, match="No clusters"):
        bulk.cluster(frame(x).limit(0), "k", "v")


def test_streaming_ingest(spark, tmp_path):
    from veldra.streaming.ingest import append_stream

    source = f"{tmp_path}/in"
    spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "id long, vec array<float>").write.parquet(source)
    engine = VectorEngine(spark)
    engine.create_index("i", spark.createDataFrame([], "id long, vec array<float>"), "vec", "id")
    stream = spark.readStream.schema("id long, vec array<float>").parquet(source)
    append_stream(engine, "i", stream, f"{tmp_path}/ckpt").awaitTermination(60)
    assert engine.count("i") == 20
