"""The SQL surface."""

import pytest

from veldra.plans.options import IndexError_
from veldra.plans.session import VectorSession


@pytest.fixture
def session(spark):
    own = VectorSession(spark)
    own.register("t1", spark.createDataFrame([(i, [float(i % 9), float(i // 9 % 9), float(i // 81)]) for i in range(729)], "id long, vec array<float>"), "id")
    own.register("probes", spark.createDataFrame([(0, [5.0, 5.0, 5.0]), (1, [1.0, 1.0, 1.0])], "pid long, pv array<float>"), "pid")
    return own


def test_index_statements(session):
    session.sql("CREATE INDEX my_idx ON t1 USING HNSW (vec) WITH (metric = 'cosine', M = 8, ef_construction = 16)")
    session.sql("CREATE INDEX IF NOT EXISTS my_idx ON t1 USING HNSW (vec)")
    session.sql("CREATE INDEX l2_idx ON t1 USING HNSW (vec) WITH (M = 8, ef_construction = 32)")
    rows = session.sql("SELECT index_name, metric, dimensions, count FROM pragma_hnsw_index_info() ORDER BY index_name").collect()
    assert [tuple(r) for r in rows] == [("l2_idx", "l2sq", 3, 729), ("my_idx", "cosine", 3, 729)]
    session.sql("SET hnsw_ef_search = 1000")
    near = session.sql("SELECT id, array_distance(vec, [1, 2, 3]::FLOAT[3]) AS d FROM t1 ORDER BY array_distance(vec, [1, 2, 3]::FLOAT[3]) LIMIT 3").collect()
    assert [r["d"] for r in near] == [0.0, 1.0, 1.0]
    swapped = session.sql("SELECT id FROM t1 ORDER BY array_distance([1, 2, 3]::FLOAT[3], vec) LIMIT 3").collect()
    assert [r["id"] for r in swapped] == [r["id"] for r in near]
    session.engine.remove("l2_idx", [near[0]["id"]])
    session.sql("PRAGMA hnsw_compact_index('l2_idx')")
    assert session.engine.count("l2_idx") == 728
    session.sql("DROP INDEX my_idx")
    session.sql("DROP INDEX IF EXISTS my_idx")
    session.sql("RESET hnsw_ef_search")
    assert session.engine.settings["hnsw_ef_search"] == 0


@pytest.mark.parametrize("text,message", [
    ("CREATE INDEX x ON t1 USING HNSW (vec) WITH (metric = 1)", "must be a string"),
    ("CREATE INDEX x ON t1 USING HNSW (vec) WITH (foo = 1)", "Unknown option for HNSW index: 'foo'"),
    ("CREATE INDEX x ON t1 USING HNSW (vec, id)", "single column"),
    ("PRAGMA hnsw_compact_index", "Expected one argument"),
    ("PRAGMA hnsw_compact_index(5)", "Expected a string"),
    ("PRAGMA hnsw_compact_index('none')", "Index none not found"),
])
def test_messages(session, text, message):
    with pytest.raises(IndexError_, match=message):
        session.sql(text)


def test_macros_and_plain_sql(session):
    rows = session.sql("SELECT score, left_tbl.pid, right_tbl.id FROM vss_join(probes, t1, pv, vec, 3, metric := 'l2')").collect()
    assert len(rows) == 6 and all(r["score"] <= 1 for r in rows)
    lists = session.sql("SELECT pid, size(matches) AS n FROM vss_match(probes, t1, pv, vec, 3)").collect()
    assert [r["n"] for r in lists] == [3, 3]
    exact = session.sql("SELECT id FROM t1 ORDER BY vec <-> [1, 2, 3]::FLOAT[3], id LIMIT 2").collect()
    assert len(exact) == 2 and exact[0]["id"] == 1 + 2 * 9 + 3 * 81
    assert session.sql("SELECT count(*) AS n FROM t1 WHERE array_inner_product(vec, [1, 0, 0]) > 4").first()["n"] == 4 * 81


def test_filtered_search_and_copy(session, spark):
    engine = session.engine
    engine.create_index("f", session.tables["t1"][0], "vec", "id", M=8, ef_construction=32)
    asked = spark.createDataFrame([(0, [1.0, 2.0, 3.0])], "q long, v array<float>")
    found = engine.search_many("f", asked, "q", "v", 5, 1000, allowed=spark.range(0, 729, 2)).collect()
    assert len(found) == 5 and all(r["key"] % 2 == 0 for r in found)
    engine.remove("f", [0])
    engine.copy_index("f", "g")
    assert engine.count("g") == 728


def test_rewrites_keep_what_is_no_distance(spark, session):
    from veldra.plans.rewrite import rewrite_expression as rewrite

    for text in ("a - 1 - array_cosine_similarity(a, b)", "2 * 1 - array_cosine_similarity(a, b)", "11 - array_cosine_similarity(a, b)", "x1 - array_cosine_similarity(a, b)",
                 "1 - array_cosine_similarity(a, b) * 2", "3 - array_inner_product(a, b)", "l.k <=> r.k"):
        assert rewrite(text) == text
    assert rewrite("SELECT 1 - array_cosine_similarity(a, b) AS d") == "SELECT array_cosine_distance(a, b) AS d"
    assert rewrite("l.v <=> r.v", {"v"}) == "array_cosine_distance(l.v, r.v)" and rewrite("v <=> array(1D)") == "array_cosine_distance(v, array(1D))"
    assert session.sql("SELECT vec[0] AS x FROM t1 WHERE id = 5").first()["x"] == 5.0
    assert session.sql("SELECT map('a', 7)['a'] AS x").first()["x"] == 7
    assert session.sql("SELECT count(*) AS n FROM t1 x JOIN t1 y ON x.id <=> y.id").first()["n"] == 729


def test_lateral_joins_show_what_they_select(spark):
    from veldra.plans.rewrite import run_sql

    spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [4.0, 5.0, 6.0])], "a_id int, a_vec array<float>").createOrReplaceTempView("lat_a")
    spark.createDataFrame([(10, [4.0, 5.0, 6.0], "b"), (11, [1.0, 2.0, 3.5], "a")], "b_id int, b_vec array<float>, b_str string").createOrReplaceTempView("lat_b")
    keys = {"lat_a": "a_id", "lat_b": "b_id"}
    got = run_sql(spark, "SELECT * FROM lat_a, LATERAL (SELECT b_str AS nbr FROM lat_b ORDER BY array_distance(a_vec, b_vec) LIMIT 1)", keys)
    assert got.columns == ["a_id", "a_vec", "nbr"] and sorted((r["a_id"], r["nbr"]) for r in got.collect()) == [(1, "a"), (2, "b")]
    text = "SELECT a_id, dist, id_dup, b_str FROM lat_a, LATERAL (SELECT array_distance(lat_a.a_vec, lat_b.b_vec) AS dist, *, a_id AS id_dup FROM lat_b ORDER BY dist LIMIT 1) x"
    assert sorted(map(tuple, run_sql(spark, text, keys).collect())) == [(1, 0.5, 1, "a"), (2, 0.0, 2, "b")]
    with pytest.raises(ValueError, match="lateral"):
        run_sql(spark, "SELECT a_id FROM lat_a, LATERAL (SELECT b_id FROM lat_b ORDER BY b_id + a_id LIMIT 1)", keys)


def test_outer_rows_of_one_key_get_their_own_neighbours(spark):
    from veldra.operators.knn import knn_join, vss_join

    outer = spark.createDataFrame([("x", [0.0, 0.0]), ("x", [9.0, 9.0]), (None, [9.0, 9.0])], "o_key string, ov array<float>")
    inner = spark.createDataFrame([(7, [0.0, 0.0]), (8, [9.0, 9.0])], "i_key long, iv array<float>")
    got = knn_join(outer, "o_key", "ov", inner, "i_key", "iv", 1).collect()
    assert sorted((r["ov"][0], r["i_key"]) for r in got) == [(0.0, 7), (9.0, 8), (9.0, 8)]
    assert vss_join(outer, inner, "o_key", "ov", "i_key", "iv", 1).count() == 3
