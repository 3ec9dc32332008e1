"""The checked queries of the engine: each one runs an operator on the test tables, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import VectorEngine
from .functions import metrics as M
from .functions import vector as V
from .operators import bulk, knn
from .plans.options import IndexError_
from .plans.rewrite import rewrite_expression, run_sql

DIM = 64
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of different lengths, so that the metrics rank differently."""
    return vectors(spark, sf_dir).withColumn("embedding", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (1 + F.col("vec_id") % 5)))


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector is null."""
    return vectors(spark, sf_dir).withColumn("embedding", F.when(F.col("vec_id") % 7 != 0, F.col("embedding")))


def first_vector(df: DataFrame) -> list[float]:
    return [float(x) for x in df.where("vec_id = 0").first()["embedding"]]


E_SQL = "SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings"
S_SQL = "SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 5)) AS v, label FROM embeddings"
#: The list functions of the checking engine take no null lists, so the SQL keeps the vector and masks the distance.
MASKED = "CASE WHEN {}.vec_id % 7 <> 0 THEN list_distance({}.v, {}.v) END"
Z = "list_zip(e.v, q.v)"


def over(form: str) -> str:
    return f"list_sum(list_transform({Z}, lambda p: {form}))"


def metric_query(name: str, metric: str, sql: str, cut: int | None = None) -> None:
    text = f"WITH e AS ({S_SQL}), q AS (SELECT v FROM e WHERE vec_id = 0) SELECT e.vec_id, round({sql}, 6) AS value FROM e, q"

    @query(name, text)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = scaled(spark, sf_dir)
        return df.select("vec_id", F.round(M.distance(metric, F.col("embedding"), first_vector(df), DIM), 6).alias("value"))


metric_query("metric_l2", "l2", "list_distance(e.v, q.v)")
metric_query("metric_l2sq", "l2sq", over("(p[1] - p[2]) * (p[1] - p[2])"))
metric_query("metric_cos_sim", "cosine_similarity", "list_cosine_similarity(e.v, q.v)")
metric_query("metric_cos_dist", "cosine_distance", "1 - list_cosine_similarity(e.v, q.v)")
metric_query("metric_cos_index", "cosine", "1 - list_cosine_similarity(e.v, q.v)")
metric_query("metric_ip", "inner_product", "list_inner_product(e.v, q.v)")
metric_query("metric_neg_ip", "negative_inner_product", "-list_inner_product(e.v, q.v)")
metric_query("metric_ip_dist", "ip", "1 - list_inner_product(e.v, q.v)")
metric_query("metric_pearson", "pearson", f"1 - (64 * {over('p[1] * p[2]')} - {over('p[1]')} * {over('p[2]')}) / sqrt((64 * {over('p[1] * p[1]')} - {over('p[1]')} * {over('p[1]')}) * (64 * {over('p[2] * p[2]')} - {over('p[2]')} * {over('p[2]')}))")


def positive_query(name: str, metric: str, sql: str) -> None:
    source = "SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: abs(x)) AS v FROM embeddings"

    @query(name, f"WITH e AS ({source}), q AS (SELECT v FROM e WHERE vec_id = 0) SELECT e.vec_id, round({sql}, 6) AS value FROM e, q")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = vectors(spark, sf_dir).withColumn("embedding", F.transform(F.col("embedding").cast("array<double>"), F.abs))
        return df.select("vec_id", F.round(M.distance(metric, F.col("embedding"), first_vector(df), DIM), 6).alias("value"))


_EPS = "1.1920928955078125e-07"
_MID = f"((p[1] + p[2]) / 2 + {_EPS})"
positive_query("metric_js", "divergence", over(f"p[1] * ln((p[1] + {_EPS}) / {_MID}) + p[2] * ln((p[2] + {_EPS}) / {_MID})") + " / 2")
positive_query("metric_kl", "kullback_leibler", over(f"p[1] * ln((p[1] + {_EPS}) / (p[2] + {_EPS}))"))


@query(
    "metric_haversine",
    "WITH e AS (SELECT vec_id, embedding[1]::DOUBLE * 90 AS lat, embedding[2]::DOUBLE * 180 AS lon FROM embeddings), q AS (SELECT lat, lon FROM e WHERE vec_id = 0) "
    "SELECT e.vec_id, round(2 * asin(sqrt(pow(sin(radians(q.lat - e.lat) / 2), 2) + cos(radians(e.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - e.lon) / 2), 2))), 6) AS value FROM e, q",
)
def metric_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir).select("vec_id", F.array(F.col("embedding")[0].cast("double") * 90, F.col("embedding")[1].cast("double") * 180).alias("embedding"))
    return df.select("vec_id", F.round(M.distance("haversine", F.col("embedding"), first_vector(df), 2), 6).alias("value"))


def bit_query(name: str, metric: str, sql: str) -> None:
    @query(name, f"WITH e AS ({E_SQL}), q AS (SELECT v FROM e WHERE vec_id = 0) SELECT e.vec_id, round({sql}::DOUBLE, 6) AS value FROM e, q")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = vectors(spark, sf_dir).select("vec_id", M.to_bits(F.col("embedding")).alias("embedding"))
        words = df.where("vec_id = 0").first()["embedding"]
        constant = F.array(*(F.lit(w).cast("long") for w in words))
        return df.select("vec_id", F.round(M.distance(metric, F.col("embedding"), constant).cast("double"), 6).alias("value"))


bit_query("metric_hamming", "hamming", over("CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END"))
bit_query("metric_tanimoto", "tanimoto", f"1 - {over('CASE WHEN p[1] > 0 AND p[2] > 0 THEN 1 ELSE 0 END')}::DOUBLE / {over('CASE WHEN p[1] > 0 OR p[2] > 0 THEN 1 ELSE 0 END')}")
bit_query("metric_sorensen", "sorensen", f"1 - 2 * {over('CASE WHEN p[1] > 0 AND p[2] > 0 THEN 1 ELSE 0 END')}::DOUBLE / {over('CASE WHEN p[1] > 0 THEN 1 ELSE 0 END + CASE WHEN p[2] > 0 THEN 1 ELSE 0 END')}")


@query(
    "metric_jaccard",
    "WITH e AS (SELECT vec_id, list_distinct(list_transform(embedding::DOUBLE[], lambda x: floor(x * 20)::INTEGER)) AS s FROM embeddings), q AS (SELECT s FROM e WHERE vec_id = 0) "
    "SELECT e.vec_id, round(1 - len(list_intersect(e.s, q.s))::DOUBLE / (len(e.s) + len(q.s) - len(list_intersect(e.s, q.s))), 6) AS value FROM e, q",
)
def metric_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir).select("vec_id", F.array_distinct(F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 20).cast("int"))).alias("s"))
    other = F.array(*(F.lit(x) for x in df.where("vec_id = 0").first()["s"]))
    return df.select("vec_id", F.round(M.jaccard(F.col("s"), other), 6).alias("value"))


I8 = "greatest(-100, least(100, trunc((x::FLOAT * 100::FLOAT)::FLOAT)))::INTEGER"


@query("cast_i8", f"SELECT vec_id, pos, {I8} AS value FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1)::BIGINT AS pos FROM embeddings)")
def cast_i8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("vec_id", F.posexplode(M.to_i8(F.col("embedding"))).alias("pos", "value"))
    return rows.select("vec_id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("value").cast("int").alias("value"))


@query("cast_b1", "SELECT vec_id, pos, CASE WHEN x > 0 THEN 1 ELSE 0 END AS value FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1)::BIGINT AS pos FROM embeddings)")
def cast_b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("vec_id", F.posexplode(M.from_bits(M.to_bits(F.col("embedding")), DIM)).alias("pos", "value"))
    return rows.select("vec_id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("value").cast("int").alias("value"))


def byte_query(name: str, build, sql: str) -> None:
    source = f"SELECT vec_id, list_transform(embedding, lambda x: {I8}::DOUBLE) AS v FROM embeddings"

    @query(name, f"WITH e AS ({source}), q AS (SELECT v FROM e WHERE vec_id = 0) SELECT e.vec_id, round({sql}, 6) AS value FROM e, q")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = vectors(spark, sf_dir).select("vec_id", M.to_i8(F.col("embedding")).alias("embedding"))
        return df.select("vec_id", F.round(build(F.col("embedding"), first_vector(df)), 6).alias("value"))


byte_query("metric_cos_i8", lambda a, b: M.cosine_i8(a, b, DIM), f"CASE WHEN {over('p[1] * p[2]')} = 0 THEN 0.0 ELSE 1 - list_cosine_similarity(e.v, q.v) END")
byte_query("metric_l2sq_i8", lambda a, b: M.distance("l2sq", a, b, DIM), over("(p[1] - p[2]) * (p[1] - p[2])"))


@query(
    "complex_dot",
    f"WITH e AS ({E_SQL}), q AS (SELECT v FROM e WHERE vec_id = 0), i AS (SELECT e.vec_id, unnest(range(1, 65, 2)) AS i, e.v, q.v AS w FROM e, q) "
    "SELECT vec_id, round(sum(v[i] * w[i] - v[i + 1] * w[i + 1]), 6) AS re, round(sum(v[i] * w[i + 1] + v[i + 1] * w[i]), 6) AS im, "
    "round(sum(v[i] * w[i] + v[i + 1] * w[i + 1]), 6) AS vre, round(sum(v[i] * w[i + 1] - v[i + 1] * w[i]), 6) AS vim FROM i GROUP BY vec_id",
)
def complex_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    q = V.vector(first_vector(df))
    dot, vdot = M.complex_dot(F.col("embedding"), q), M.complex_dot(F.col("embedding"), q, conjugate=True)
    return df.select("vec_id", dot.alias("d"), vdot.alias("c")).select("vec_id", *(F.round(f"{s}.{p}", 6).alias(n) for s, p, n in (("d", "re", "re"), ("d", "im", "im"), ("c", "re", "vre"), ("c", "im", "vim"))))


# --- top-k ------------------------------------------------------------------------------------------------------


def top_sql(source: str, value: str, order: str = "ASC NULLS LAST", where: str = "", limit: str = "LIMIT 5") -> str:
    return f"WITH e AS ({source}), q AS (SELECT v FROM ({S_SQL if source == S_SQL else E_SQL}) WHERE vec_id = 0) SELECT vec_id, round(d, 6) AS dist FROM (SELECT e.vec_id, e.label, {value} AS d FROM e, q) {where} ORDER BY d {order}, vec_id {limit}"


def rounded(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.round("dist", 6).alias("dist"))


def top_query(name: str, metric: str, value: str) -> None:
    @query(name, top_sql(S_SQL, value, "DESC" if M.RANKINGS[metric].descending else "ASC"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = scaled(spark, sf_dir)
        return rounded(knn.knn_scan(df, "embedding", first_vector(df), 5, "vec_id", metric))


top_query("topk_cos", "cosine_distance", "1 - list_cosine_similarity(e.v, q.v)")
top_query("topk_ip", "negative_inner_product", "-list_inner_product(e.v, q.v)")
top_query("topk_cos_sim_desc", "cosine_similarity", "list_cosine_similarity(e.v, q.v)")


@query("topk_l2", top_sql(E_SQL, "list_distance(e.v, q.v)"))
def topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return rounded(knn.knn_scan(df, "embedding", first_vector(df), 5, "vec_id"))


@query("topk_swapped", top_sql(E_SQL, "list_distance(q.v, e.v)"))
def topk_swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    d = V.array_distance(F.col("q"), F.col("embedding"))
    return rounded(df.withColumn("q", V.vector(first_vector(df))).withColumn("dist", d).orderBy("dist", "vec_id").limit(5))


@query("topk_filter_label", top_sql(E_SQL, "list_distance(e.v, q.v)", where="WHERE label = 3"))
def topk_filter_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return rounded(knn.knn_scan(df, "embedding", first_vector(df), 5, "vec_id", where="label = 3"))


@query("topk_post_filter", f"SELECT vec_id, dist FROM ({top_sql(E_SQL, 'list_distance(e.v, q.v)', limit='LIMIT 50')}) WHERE vec_id IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def topk_post_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return rounded(knn.knn_scan(df, "embedding", first_vector(df), 50, "vec_id", where="label = 3", post_filter=True))


@query("topk_offset", top_sql(E_SQL, "list_distance(e.v, q.v)", limit="LIMIT 5 OFFSET 7"))
def topk_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return rounded(knn.knn_scan(df, "embedding", first_vector(df), 5, "vec_id", offset=7))


@query("topk_k_gt_n", top_sql(E_SQL, "list_distance(e.v, q.v)", where="WHERE label = 1", limit="LIMIT 100000"))
def topk_k_gt_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return rounded(knn.knn_scan(df, "embedding", first_vector(df), 100_000, "vec_id", where="label = 1"))


@query("topk_null_vectors", top_sql(E_SQL, MASKED.format("e", "e", "q"), where="WHERE label = 2", limit="LIMIT 100000"))
def topk_null_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = holed(spark, sf_dir)
    return rounded(knn.knn_scan(df, "embedding", first_vector(vectors(spark, sf_dir)), 100_000, "vec_id", where="label = 2"))


@query("topk_expr_key", top_sql("SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * x) AS v, label FROM embeddings", "list_distance(e.v, q.v)"))
def topk_expr_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    squared = df.withColumn("embedding", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * x))
    return rounded(knn.knn_scan(squared, "embedding", first_vector(df), 5, "vec_id"))


@query("topk_projection", f"SELECT label, vec_id FROM ({top_sql(E_SQL, 'list_distance(e.v, q.v)')}) JOIN embeddings USING (vec_id)")
def topk_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return knn.knn_scan(df, "embedding", first_vector(df), 5, "vec_id", columns=["label", "vec_id"])


@query("topk_grid", "SELECT round(sqrt((a - 1) ** 2 + (b - 2) ** 2 + (c - 3) ** 2), 6) AS dist FROM (SELECT unnest(range(1, 10)) a), (SELECT unnest(range(1, 10)) b), (SELECT unnest(range(1, 10)) c) ORDER BY dist LIMIT 3")
def topk_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    digit = F.col("id")
    grid = spark.range(729).select(F.array(1 + digit % 9, 1 + F.floor(digit / 9) % 9, 1 + F.floor(digit / 81)).cast("array<float>").alias("vec"), "id")
    return knn.knn_scan(grid, "vec", [1.0, 2.0, 3.0], 3, "id").select(F.round("dist", 6).alias("dist"))


def listed(df: DataFrame, name: str = "vec_id") -> DataFrame:
    """The entries of the one list, with their places."""
    return df.select(F.posexplode("best").alias("pos", name)).withColumn("pos", (F.col("pos") + 1).cast("long"))


def list_sql(value: str, order: str, where: str = "") -> str:
    return f"WITH e AS ({S_SQL}), q AS (SELECT v FROM e WHERE vec_id = 0) SELECT row_number() OVER (ORDER BY d {order}, vec_id) AS pos, vec_id FROM (SELECT e.vec_id, {value} AS d FROM e, q {where} ORDER BY d {order}, vec_id LIMIT 5)"


@query("minby_k", list_sql("list_distance(e.v, q.v)", "ASC"))
def minby_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scaled(spark, sf_dir)
    return listed(knn.min_by_k(df, F.col("vec_id"), M.constant_distance("l2", "embedding", first_vector(df)), 5, key="vec_id"))


@query("maxby_k", list_sql("list_inner_product(e.v, q.v)", "DESC"))
def maxby_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scaled(spark, sf_dir)
    return listed(knn.max_by_k(df, F.col("vec_id"), M.constant_distance("inner_product", "embedding", first_vector(df)), 5, key="vec_id"))


@query("minby_k_filter", list_sql("list_distance(e.v, q.v)", "ASC", "WHERE e.label = 4"))
def minby_k_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scaled(spark, sf_dir)
    return listed(knn.min_by_k(df, F.col("vec_id"), V.array_distance(F.col("embedding"), first_vector(df), DIM), 5, key="vec_id", where="label = 4"))


@query("minby_flatten_sum", f"WITH e AS ({S_SQL}), q AS (SELECT v FROM e WHERE vec_id = 0) SELECT round(sum(list_sum(v)), 6) AS total, sum(len(v))::BIGINT AS n FROM (SELECT e.v FROM e, q ORDER BY list_distance(e.v, q.v), vec_id LIMIT 3)")
def minby_flatten_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scaled(spark, sf_dir)
    best = knn.min_by_k(df, F.col("embedding"), V.array_distance(F.col("embedding"), first_vector(df), DIM), 3, key="vec_id")
    flat = F.flatten("best")
    return best.select(F.round(F.aggregate(flat, F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.size(flat).cast("long").alias("n"))


# --- joins ------------------------------------------------------------------------------------------------------


def join_sql(value: str, order: str = "ASC NULLS LAST", k: int = 3, outer: str = S_SQL, inner: str = S_SQL, what: str = "vec_id, nbr, rn, round(d, 6) AS dist") -> str:
    return (
        f"SELECT {what} FROM (SELECT a.vec_id, b.vec_id AS nbr, {value} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {value} {order}, b.vec_id) AS rn "
        f"FROM ({outer}) a, ({inner}) b) WHERE rn <= {k}"
    )


def pairs(left: DataFrame, right: DataFrame, k: int = 3, metric: str = "l2", **more) -> DataFrame:
    found = knn.knn_pairs(left, "vec_id", "embedding", right, "vec_id", "embedding", k, metric, **more)
    return found.select(F.col("o").alias("vec_id"), F.col("i").alias("nbr"), "rn", F.round("dist", 6).alias("dist"))


def join_query(name: str, metric: str, value: str, order: str, **more) -> None:
    @query(name, join_sql(value, order))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = scaled(spark, sf_dir)
        return pairs(df, df, metric=metric, **more)


join_query("knn_join_l2", "l2", "list_distance(a.v, b.v)", "ASC")
join_query("knn_join_cos", "cosine_distance", "(1 - list_cosine_similarity(a.v, b.v))", "ASC")
join_query("knn_join_ip", "negative_inner_product", "(-list_inner_product(a.v, b.v))", "ASC")
#: The same rows from the path for inner sides that are too large to broadcast.
join_query("knn_join_blocks", "l2", "list_distance(a.v, b.v)", "ASC", broadcast_bytes=0)


@query("knn_join_rn", join_sql("list_distance(a.v, b.v)", what="vec_id, rn, nbr", k=2))
def knn_join_rn(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scaled(spark, sf_dir)
    return pairs(df, df, 2).select("vec_id", "rn", "nbr")


@query("knn_join_count", join_sql("list_distance(a.v, b.v)", what="count(*)::BIGINT AS n, count(DISTINCT vec_id)::BIGINT AS outers, min(rn) AS lo, max(rn) AS hi"))
def knn_join_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scaled(spark, sf_dir)
    return pairs(df, df).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("outers"), F.min("rn").alias("lo"), F.max("rn").alias("hi"))


@query("knn_join_group_list", f"SELECT vec_id, string_agg(nbr::VARCHAR, ',' ORDER BY rn) AS nbrs FROM ({join_sql('list_distance(a.v, b.v)', what='vec_id, nbr, rn')}) GROUP BY vec_id")
def knn_join_group_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scaled(spark, sf_dir)
    return knn.knn_lists(df, "vec_id", "embedding", df, "vec_id", "embedding", 3).select("vec_id", F.array_join("neighbours", ",").alias("nbrs"))


@query("knn_join_null_inner", join_sql(MASKED.format("b", "a", "b"), outer=f"{E_SQL} WHERE label = 1", inner=f"{E_SQL} WHERE label = 2", k=60))
def knn_join_null_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(vectors(spark, sf_dir).where("label = 1"), holed(spark, sf_dir).where("label = 2"), 60)


@query("knn_join_null_outer", join_sql(MASKED.format("a", "a", "b"), outer=E_SQL, inner=E_SQL))
def knn_join_null_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(holed(spark, sf_dir), vectors(spark, sf_dir))


DUP_SQL = f"SELECT vec_id, v, label FROM ({E_SQL}) UNION ALL SELECT vec_id + 1000000, v, label FROM ({E_SQL})"


@query("knn_join_dup_outer", join_sql("list_distance(a.v, b.v)", outer=DUP_SQL, inner=E_SQL))
def knn_join_dup_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return pairs(df.unionByName(df.withColumn("vec_id", F.col("vec_id") + 1_000_000)), df)


@query("knn_join_columns", join_sql("list_distance(a.v, b.v)", k=1, what="nbr AS item, rn, vec_id AS asked, round(d, 6) AS dist", inner=f"{S_SQL} WHERE label > 4"))
def knn_join_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scaled(spark, sf_dir)
    outer, inner = df.select(F.col("vec_id").alias("asked"), F.col("embedding").alias("av")), df.where("label > 4").select(F.col("vec_id").alias("item"), F.col("embedding").alias("bv"))
    return knn.knn_join(outer, "asked", "av", inner, "item", "bv", 1).select("item", "rn", "asked", F.round("dist", 6).alias("dist"))


@query("knn_join_lateral_sql", join_sql("list_distance(a.v, b.v)", k=2, what="vec_id AS asked, nbr AS item", outer=f"{S_SQL} WHERE label = 0"))
def knn_join_lateral_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scaled(spark, sf_dir)
    df.where("label = 0").select(F.col("vec_id").alias("asked"), F.col("embedding").alias("av")).createOrReplaceTempView("veldra_asked")
    df.select(F.col("vec_id").alias("item"), F.col("embedding").alias("bv")).createOrReplaceTempView("veldra_items")
    text = "SELECT asked, item FROM veldra_asked, LATERAL (SELECT item FROM veldra_items ORDER BY array_distance(veldra_asked.av, veldra_items.bv) LIMIT 2)"
    return run_sql(spark, text, {"veldra_asked": "asked", "veldra_items": "item"})


def macro_query(metric: str, value: str, order: str) -> None:
    short = {"l2sq": "l2", "cosine": "cos", "ip": "ip"}[metric]
    outer = S_SQL

    def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
        df = scaled(spark, sf_dir)
        return df.select(F.col("vec_id").alias("lid"), F.col("embedding").alias("lv")), df.select("vec_id", "embedding")

    @query(f"vss_join_{short}", join_sql(value, order, outer=outer, what="round(d, 6) AS score, vec_id AS left_id, nbr AS right_id"))
    def join(spark: SparkSession, sf_dir: str) -> DataFrame:
        left, right = sides(spark, sf_dir)
        found = knn.vss_join(left, right, "lid", "lv", "vec_id", "embedding", 3, metric)
        return found.select(F.round("score", 6).alias("score"), F.col("left_tbl.lid").alias("left_id"), F.col("right_tbl.vec_id").alias("right_id"))

    @query(f"vss_match_{short}", join_sql(value, order, outer=outer, what="vec_id AS lid, rn AS pos, round(d, 6) AS score, nbr AS id"))
    def match(spark: SparkSession, sf_dir: str) -> DataFrame:
        left, right = sides(spark, sf_dir)
        found = knn.vss_match(left, right, "lid", "lv", "vec_id", "embedding", 3, metric)
        rows = found.select("lid", F.posexplode("matches").alias("pos", "m"))
        return rows.select("lid", (F.col("pos") + 1).cast("long").alias("pos"), F.round("m.score", 6).alias("score"), F.col("m.row.vec_id").alias("id"))

    if metric == "l2sq":

        @query("vss_match_len", f"SELECT count(*)::BIGINT AS n, min(c)::BIGINT AS lo, max(c)::BIGINT AS hi FROM (SELECT vec_id, count(*) AS c FROM ({join_sql(value, order, outer=outer)}) GROUP BY vec_id)")
        def length(spark: SparkSession, sf_dir: str) -> DataFrame:
            left, right = sides(spark, sf_dir)
            n = F.size("matches").cast("long")
            return knn.vss_match(left, right, "lid", "lv", "vec_id", "embedding", 3, metric).agg(F.count(F.lit(1)).alias("n"), F.min(n).alias("lo"), F.max(n).alias("hi"))

        @query("vss_join_score_bound", f"SELECT bool_and(d <= 1.0) AS bounded, count(*)::BIGINT AS n FROM ({join_sql(value, order, outer=outer, k=1, what='d')})")
        def bound(spark: SparkSession, sf_dir: str) -> DataFrame:
            left, right = sides(spark, sf_dir)
            return knn.vss_join(left, right, "lid", "lv", "vec_id", "embedding", 1, metric).agg(F.bool_and(F.col("score") <= 1.0).alias("bounded"), F.count(F.lit(1)).alias("n"))


macro_query("l2sq", "list_distance(a.v, b.v)", "ASC")
macro_query("cosine", "list_cosine_similarity(a.v, b.v)", "DESC")
macro_query("ip", "list_inner_product(a.v, b.v)", "DESC")


def rewrite_query(name: str, text: str, sql: str) -> None:
    @query(name, f"WITH e AS ({S_SQL}), q AS (SELECT v FROM e WHERE vec_id = 0) SELECT e.vec_id, round({sql}, 6) AS value FROM e, q")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        V.register(spark)
        df = scaled(spark, sf_dir)
        rewritten = rewrite_expression(text, {"embedding", "q"})
        if rewritten == text:
            raise AssertionError(text)
        return df.withColumn("q", V.vector(first_vector(df))).selectExpr("vec_id", f"round({rewritten}, 6) AS value")


rewrite_query("rewrite_cosine", "1.0 - array_cosine_similarity(embedding, q)", "1 - list_cosine_similarity(e.v, q.v)")
rewrite_query("rewrite_neg_ip", "-array_inner_product(embedding, q)", "-list_inner_product(e.v, q.v)")
rewrite_query("rewrite_operator_l2", "embedding <-> q", "list_distance(e.v, q.v)")
rewrite_query("rewrite_operator_cos", "embedding <=> q", "1 - list_cosine_similarity(e.v, q.v)")
rewrite_query("rewrite_minus_one", "round(2 * 1 - array_cosine_similarity(embedding, q), 6) + (1 - array_cosine_similarity(embedding, q))", "round(2 * 1 - list_cosine_similarity(e.v, q.v), 6) + (1 - list_cosine_similarity(e.v, q.v))")
rewrite_query("rewrite_left_minus", "vec_id - 1 - array_cosine_similarity(embedding, q) + array_negative_inner_product(embedding, q) - array_inner_product(embedding, q) + (embedding <-> q)", "e.vec_id - 1 - list_cosine_similarity(e.v, q.v) - 2 * list_inner_product(e.v, q.v) + list_distance(e.v, q.v)")
rewrite_query("rewrite_operator_ip", "embedding <#> q", "-list_inner_product(e.v, q.v)")


# --- bulk operators ---------------------------------------------------------------------------------------------


@query("exact_batch", join_sql("list_distance(a.v, b.v)", k=10, outer=f"{S_SQL} WHERE vec_id % 10 = 0"))
def exact_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scaled(spark, sf_dir)
    return pairs(df.where("vec_id % 10 = 0"), df, 10)


@query("exact_batch_k1", join_sql("list_distance(a.v, b.v)", k=1, outer=f"{S_SQL} WHERE vec_id % 10 = 0", inner=f"{S_SQL} WHERE vec_id % 10 <> 0"))
def exact_batch_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scaled(spark, sf_dir)
    return pairs(df.where("vec_id % 10 = 0"), df.where("vec_id % 10 <> 0"), 1)


@query("group_distance_stats", f"SELECT count(*)::BIGINT AS pairs, round(avg(d), 6) AS mean_dist, round(min(d), 6) AS min_dist, round(max(d), 6) AS max_dist FROM (SELECT list_distance(a.v, b.v) AS d FROM ({E_SQL} WHERE label = 1) a, ({E_SQL} WHERE label = 2) b)")
def group_distance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    got = bulk.group_distance_stats(df.where("label = 1"), "embedding", df.where("label = 2"), "embedding")
    return got.select("pairs", *(F.round(c, 6).alias(c) for c in ("mean_dist", "min_dist", "max_dist")))


@query("radius_filter", f"WITH e AS ({E_SQL}), q AS (SELECT v FROM e WHERE vec_id = 0) SELECT e.vec_id, round(list_distance(e.v, q.v), 6) AS dist FROM e, q WHERE list_distance(e.v, q.v) <= 1.3")
def radius_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return rounded(knn.within(df, "embedding", first_vector(df), 1.3, "vec_id"))


@query("cluster_assign", join_sql("list_distance(a.v, b.v)", k=1, outer=E_SQL, inner=f"{E_SQL} WHERE (vec_id * 2654435761 + 12345) % 16 = 0", what="vec_id, nbr AS centroid, round(d, 6) AS dist"))
def cluster_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bulk.cluster(vectors(spark, sf_dir), "vec_id", "embedding").select("vec_id", "centroid", F.round("dist", 6).alias("dist"))


#: The closest free pair, again and again.
MATCH_SQL = f"""
WITH RECURSIVE p AS (
  SELECT a.vec_id AS m, b.vec_id AS w, list_distance(a.v, b.v) AS d FROM ({E_SQL} WHERE label < 2) a, ({E_SQL} WHERE label IN (2, 3)) b
), r AS (
  SELECT * FROM (SELECT m, w, d, [m] AS ms, [w] AS ws FROM p ORDER BY d, m, w LIMIT 1)
  UNION ALL
  SELECT * FROM (
    SELECT p.m, p.w, p.d, list_append(r.ms, p.m) AS ms, list_append(r.ws, p.w) AS ws FROM r, p
    WHERE NOT list_contains(r.ms, p.m) AND NOT list_contains(r.ws, p.w) ORDER BY p.d, p.m, p.w LIMIT 1)
)
SELECT m AS man, w AS woman, round(d, 6) AS dist FROM r
"""


@query("match_one_to_one", MATCH_SQL)
def match_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    got = bulk.match_one_to_one(df.where("label < 2"), "vec_id", "embedding", df.where("label in (2, 3)"), "vec_id", "embedding")
    return got.select("man", "woman", F.round("dist", 6).alias("dist"))


# --- indexes ----------------------------------------------------------------------------------------------------


def engine(spark: SparkSession) -> VectorEngine:
    return VectorEngine(spark)


@query("index_info", "SELECT 'idx' AS index_name, 'embeddings' AS table_name, 'l2sq' AS metric, 64::BIGINT AS dimensions, count(embedding)::BIGINT AS count FROM embeddings")
def index_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = engine(spark)
    own.create_index("idx", vectors(spark, sf_dir), "embedding", "vec_id", "embeddings", M=8, ef_construction=32)
    return own.info().select("index_name", "table_name", "metric", "dimensions", "count")


@query("index_count_null", "SELECT count(*)::BIGINT AS n FROM embeddings WHERE vec_id % 7 <> 0")
def index_count_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = engine(spark)
    own.create_index("idx", holed(spark, sf_dir), "embedding", "vec_id", M=8, ef_construction=32)
    return own.vectors("idx").agg(F.count(F.lit(1)).alias("n"))


@query("index_count_after_insert", "SELECT count(*)::BIGINT AS n, sum(vec_id)::BIGINT AS total FROM embeddings WHERE label < 4")
def index_count_after_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, df = engine(spark), vectors(spark, sf_dir)
    own.create_index("idx", df.where("label < 2"), "embedding", "vec_id", M=8, ef_construction=32)
    own.insert("idx", df.where("label in (2, 3)"))
    return own.vectors("idx").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("total"))


@query("index_count_after_delete", "SELECT count(*)::BIGINT AS n, sum(vec_id)::BIGINT AS total FROM embeddings WHERE label < 3 AND vec_id % 3 <> 0")
def index_count_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, df = engine(spark), vectors(spark, sf_dir)
    own.create_index("idx", df.where("label < 3"), "embedding", "vec_id", M=8, ef_construction=32)
    own.remove("idx", df.where("vec_id % 3 = 0").select("vec_id"))
    return own.vectors("idx").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("total"))


@query("index_compact", "SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS capacity FROM embeddings WHERE label IN (0, 1, 2) AND vec_id % 2 = 0")
def index_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, df = engine(spark), vectors(spark, sf_dir)
    own.create_index("idx", df.where("label < 2"), "embedding", "vec_id", M=8, ef_construction=32)
    own.insert("idx", df.where("label = 2"))
    own.remove("idx", df.where("vec_id % 2 = 1").select("vec_id"))
    own.compact("idx")
    return own.info().select(F.col("count").alias("n"), "capacity")


@query("index_deleted_never_found", top_sql(E_SQL, "list_distance(e.v, q.v)", where="WHERE vec_id % 2 = 1"))
def index_deleted_never_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, df = engine(spark), vectors(spark, sf_dir)
    own.create_index("idx", df, "embedding", "vec_id", "embeddings", M=8, ef_construction=64)
    own.remove("idx", df.where("vec_id % 2 = 0").select("vec_id"))
    return rounded(own.search(df, "embeddings", "embedding", "vec_id", first_vector(df), 5, mode="ann", ef_search=2000))


@query("index_choice_by_metric", "SELECT * FROM (VALUES ('cosine', 'idx_cosine'), ('ip', 'idx_ip'), ('l2sq', 'idx_l2sq')) t(metric, chosen)")
def index_choice_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, df = engine(spark), vectors(spark, sf_dir).where("label = 0")
    for metric in ("l2sq", "cosine", "ip"):
        own.create_index(f"idx_{metric}", df, "embedding", "vec_id", "embeddings", metric=metric, M=4, ef_construction=8)
    return spark.createDataFrame([(m, own.choose("embeddings", "embedding", m)) for m in ("cosine", "ip", "l2sq")], "metric string, chosen string")


#: Wrong options and what is said about them.
WRONG = [
    ("metric_kind", {"metric": 1}, "HNSW index 'metric' must be a string"),
    ("metric_name", {"metric": "foo"}, "HNSW index 'metric' must be one of: 'cosine', 'ip', 'l2sq'"),
    ("ef_construction_kind", {"ef_construction": "x"}, "HNSW index 'ef_construction' must be an integer"),
    ("ef_construction_low", {"ef_construction": 0}, "HNSW index 'ef_construction' must be at least 1"),
    ("ef_search_kind", {"ef_search": "x"}, "HNSW index 'ef_search' must be an integer"),
    ("ef_search_low", {"ef_search": 0}, "HNSW index 'ef_search' must be at least 1"),
    ("m_kind", {"M": "x"}, "HNSW index 'M' must be an integer"),
    ("m_low", {"M": 1}, "HNSW index 'M' must be at least 2"),
    ("m0_kind", {"M0": "x"}, "HNSW index 'M0' must be an integer"),
    ("m0_low", {"M0": 1}, "HNSW index 'M0' must be at least 2"),
    ("unknown", {"foo": 1}, "Unknown option for HNSW index: 'foo'"),
]


@query("index_option_errors", "SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(n, m.replace("'", "''")) for n, _, m in WRONG) + ") t(option, message)")
def index_option_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, df, rows = engine(spark), vectors(spark, sf_dir).limit(0), []
    for name, options, _ in WRONG:
        try:
            own.create_index("idx", df, "embedding", "vec_id", **options)
            rows.append((name, None))
        except IndexError_ as error:
            rows.append((name, str(error)))
    return spark.createDataFrame(rows, "option string, message string")


def recall_query(short: str, metric: str) -> None:
    shown = M.INDEX_METRICS[metric]

    @query(f"ann_recall_{short}", "SELECT count(*)::BIGINT AS queries, true AS recall_ok FROM embeddings WHERE vec_id % 25 = 0")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own, df = engine(spark), scaled(spark, sf_dir).withColumn("embedding", F.col("embedding").cast("array<float>"))
        own.create_index("idx", df, "embedding", "vec_id", metric=metric, M=12, ef_construction=64)
        asked = df.where("vec_id % 25 = 0")
        found = own.search_many("idx", asked, "vec_id", "embedding", 10, 128).select(F.col("query").alias("o"), F.col("key").alias("i"), F.lit(1).alias("hit"))
        exact = knn.knn_pairs(asked, "vec_id", "embedding", df, "vec_id", "embedding", 10, shown)
        share = F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))
        return exact.join(found, ["o", "i"], "left").agg(F.countDistinct("o").alias("queries"), (share >= 0.9).alias("recall_ok"))


recall_query("l2", "l2sq")
recall_query("cos", "cosine")
recall_query("ip", "ip")


@query("ann_exhaustive_ef", join_sql("list_distance(a.v, b.v)", outer=f"{E_SQL} WHERE vec_id % 25 = 0", inner=E_SQL, k=5))
def ann_exhaustive_ef(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, df = engine(spark), vectors(spark, sf_dir)
    own.create_index("idx", df, "embedding", "vec_id", M=12, ef_construction=64)
    found = own.search_many("idx", df.where("vec_id % 25 = 0"), "vec_id", "embedding", 5, 5000)
    return found.select(F.col("query").alias("vec_id"), F.col("key").alias("nbr"), F.col("rn").cast("long").alias("rn"), F.round("dist", 6).alias("dist"))
