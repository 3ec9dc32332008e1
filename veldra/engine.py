"""The engine: named approximate indexes over DataFrames, their life cycle, and search that falls back to exact.

An index is a folder: ``segment-n`` holds the graph rows of all parts, ``delta-n`` rows that came later, ``gone-n``
keys that went, and ``meta.json`` names what is current.  Files never change; ``meta.json`` is replaced last, so a
reader or a lost job sees a whole index.  Graphs are built and searched one bounded part per task; vectors are dealt
to parts by a hash of their key.  New rows are searched by brute force until the index is compacted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.metrics import INDEX_METRICS, distance
from .functions.vector import vector
from .operators.graph import Graph
from .operators.knn import knn_pairs, knn_scan
from .operators.nearest import Candidates
from .plans import messages
from .plans.options import MAX_K, IndexError_, IndexOptions
from .sources import files

#: Rows a part is meant to hold: some minutes of building, some MB of vectors.
PART_ROWS = 20_000
#: A beam that keeps one row of so many or more would measure most of a part, and might still miss rows that no link
#: leads to: the part is scanned, which finds the nearest for certain.
SCAN_SHARE = 5
SEGMENT = "part int, slot int, key long, level int, neighbors array<array<int>>, vec array<float>"
INFO = (
    "catalog_name string, schema_name string, index_name string, table_name string, metric string, dimensions long, count long, capacity long, "
    "approx_memory_usage long, levels long, levels_stats array<struct<nodes:long,edges:long,max_edges:long,allocated_bytes:long>>"
)


class VectorEngine:
    """``path`` keeps indexes beyond the session and needs the persistence setting; without it they live in the
    session's shared working folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, conf: dict | None = None):
        self.spark = spark
        self.settings = {"hnsw_enable_experimental_persistence": False, "hnsw_ef_search": 0} | {k.lower(): v for k, v in (conf or {}).items()}
        self.persistent = path is not None
        self.root = (path or f"{files.working_dir(spark)}/indexes-{uuid.uuid4().hex}").rstrip("/")
        self.metas: dict[str, dict] = {}
        if self.persistent:
            for name in files.children(spark, self.root):
                if files.exists(spark, f"{self.root}/{name}/meta.json"):
                    self.metas[name.lower()] = json.loads(files.read_text(spark, f"{self.root}/{name}/meta.json"))

    # --- definition -------------------------------------------------------------------------------------------

    def create_index(self, name: str, df: DataFrame, column: str | list[str], key: str, table: str = "", if_not_exists: bool = False, unique: bool = False, part_rows: int = PART_ROWS, **options) -> None:
        """Build an index of one fixed-size float vector column; rows with a null vector are left out."""
        if unique:
            raise IndexError_(messages.UNIQUE)
        if self.persistent and not self.settings["hnsw_enable_experimental_persistence"]:
            raise IndexError_(messages.PERSISTENCE)
        parsed = IndexOptions.parse(options)
        columns = [column] if isinstance(column, str) else list(column)
        if len(columns) != 1:
            raise IndexError_(messages.ONE_COLUMN)
        kind = df.schema[columns[0]].dataType if columns[0] in df.columns else df.select(F.expr(columns[0])).schema[0].dataType
        if not isinstance(kind, T.ArrayType):
            raise IndexError_(messages.KEY_ARRAY)
        if not isinstance(kind.elementType, T.FloatType):
            raise IndexError_(messages.KEY_SCALAR)
        if name.lower() in self.metas:
            if if_not_exists:
                return
            raise IndexError_(messages.NAME_TAKEN.format(name))
        rows = df.select(F.col(key).cast("long").alias("key"), F.expr(columns[0]).alias("vec")).where("vec is not null")
        meta = {"name": name, "table": table, "column": columns[0], "key": key, "options": parsed.as_dict(), "dim": None, "part_rows": part_rows, "parts": 0, "segment": None, "delta": [], "gone": []}
        self._build(meta, rows)
        self._save(meta)

    def _build(self, meta: dict, rows: DataFrame) -> None:
        shape = rows.agg(
            F.count(F.lit(1)).alias("n"), F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi"),
            F.count_if(F.exists("vec", lambda x: x.isNull())).alias("holes"), F.count_if(F.col("key").isNull()).alias("keyless"),
        ).first()
        if shape["holes"] or shape["keyless"]:
            raise IndexError_(messages.NULL_VECTOR)
        if shape["n"] and (shape["lo"] != shape["hi"] or (meta["dim"] or shape["lo"]) != shape["lo"]):
            raise IndexError_("all vectors of an index must have the same dimension")
        if not rows.groupBy("key").count().where("count > 1").isEmpty():
            raise IndexError_(messages.DUPLICATE_KEYS)
        meta["dim"] = meta["dim"] or shape["lo"]
        meta["parts"] = max(1, -(-shape["n"] // meta["part_rows"]))
        o = meta["options"]

        def build(table: pa.Table) -> pa.Table:
            table = table.sort_by("key")
            keys = table.column("key").to_numpy()
            vectors = np.asarray(table.column("vec").combine_chunks().flatten(), np.float64).reshape(len(keys), -1)
            graph = Graph.build(keys, vectors, o["metric"], o["M"], o["M0"], o["ef_construction"])
            part = table.column("part")[0].as_py()
            slots, own, levels, links, vecs = zip(*graph.rows(), strict=True)
            return pa.table({
                "part": pa.array([part] * len(keys), pa.int32()), "slot": pa.array(slots, pa.int32()), "key": pa.array(own, pa.int64()), "level": pa.array(levels, pa.int32()),
                "neighbors": pa.array(links, pa.list_(pa.list_(pa.int32()))), "vec": pa.array([v.astype(np.float32) for v in vecs], pa.list_(pa.float32())),
            })

        # one part, one task
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(meta["parts"])).cast("int")).repartitionById(meta["parts"], F.col("part"))
        segment = f"{self.root}/{meta['name']}/segment-{uuid.uuid4().hex}"
        dealt.groupBy("part").applyInArrow(build, SEGMENT).write.parquet(segment)
        meta["segment"] = segment

    def _save(self, meta: dict) -> None:
        files.write_text(self.spark, f"{self.root}/{meta['name']}/meta.json", json.dumps(meta))
        self.metas[meta["name"].lower()] = meta

    def _meta(self, name: str) -> dict:
        meta = self.metas.get(name.split(".")[-1].lower())
        if meta is None:
            raise IndexError_(messages.NOT_FOUND.format(name))
        return meta

    def copy_index(self, name: str, to: str) -> None:
        """The live rows of an index under another name, with the same options."""
        meta = self._meta(name)
        if to.lower() in self.metas:
            raise IndexError_(messages.NAME_TAKEN.format(to))
        fresh = meta | {"name": to, "segment": None, "delta": [], "gone": []}
        self._build(fresh, self.vectors(name))
        self._save(fresh)

    def drop_index(self, name: str, if_exists: bool = False) -> None:
        if if_exists and name.lower() not in self.metas:
            return
        meta = self._meta(name)
        files.delete(self.spark, f"{self.root}/{meta['name']}")
        del self.metas[meta["name"].lower()]

    # --- maintenance ------------------------------------------------------------------------------------------

    def insert(self, name: str, df: DataFrame) -> None:
        """Append rows with the index's key and column; null vectors are skipped."""
        meta = dict(self._meta(name))
        rows = df.select(F.col(meta["key"]).cast("long").alias("key"), F.expr(meta["column"]).cast("array<float>").alias("vec")).where("vec is not null")
        wrong = F.lit(False) if meta["dim"] is None else F.size("vec") != meta["dim"]
        if not rows.where(wrong | F.exists("vec", lambda x: x.isNull()) | F.col("key").isNull()).isEmpty():
            raise IndexError_(messages.NULL_VECTOR)
        path = f"{self.root}/{meta['name']}/delta-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        if meta["dim"] is None:
            first = self.spark.read.schema("key long, vec array<float>").parquet(path).select(F.size("vec").alias("d")).first()
            meta["dim"] = first["d"] if first else None
        meta["delta"] = [*meta["delta"], [path, len(meta["gone"])]]
        self._save(meta)

    def remove(self, name: str, keys: DataFrame | Iterable[int]) -> None:
        """Mark keys as gone; a key may come back by a later insert."""
        meta = dict(self._meta(name))
        frame = keys.select(F.col(keys.columns[0]).cast("long").alias("key")) if isinstance(keys, DataFrame) else self.spark.createDataFrame([(int(k),) for k in keys], "key long")
        path = f"{self.root}/{meta['name']}/gone-{uuid.uuid4().hex}"
        frame.distinct().write.parquet(path)
        meta["gone"] = [*meta["gone"], path]
        self._save(meta)

    def update(self, name: str, df: DataFrame) -> None:
        meta = self._meta(name)
        self.remove(name, df.select(meta["key"]))
        self.insert(name, df)

    def rename_key(self, name: str, old: int, new: int) -> None:
        rows = self.vectors(name).where(F.col("key") == old)
        meta = self._meta(name)
        moved = rows.select(F.lit(new).cast("long").alias(meta["key"]), F.col("vec").alias(meta["column"]))
        kept = [tuple(r) for r in moved.collect()]
        self.remove(name, [old])
        if kept:
            self.insert(name, self.spark.createDataFrame(kept, moved.schema))

    def compact(self, name: str) -> None:
        """Rebuild over the live rows; marked rows go for good."""
        if not isinstance(name, str):
            raise IndexError_(messages.COMPACT_KIND)
        meta = dict(self._meta(name))
        old = [meta["segment"], *(p for p, _ in meta["delta"]), *meta["gone"]]
        self._build(meta, self.vectors(name))
        meta |= {"delta": [], "gone": []}
        self._save(meta)
        for path in old:
            files.delete(self.spark, path)

    def _gone(self, meta: dict, since: int) -> DataFrame | None:
        paths = meta["gone"][since:]
        return self.spark.read.schema("key long").parquet(*paths).distinct() if paths else None

    def _delta(self, meta: dict) -> DataFrame:
        out = self.spark.createDataFrame([], "key long, vec array<float>")
        for path, since in meta["delta"]:
            rows, gone = self.spark.read.schema("key long, vec array<float>").parquet(path), self._gone(meta, since)
            out = out.unionByName(rows if gone is None else rows.join(gone, "key", "left_anti"))
        return out

    def _graph_rows(self, meta: dict) -> DataFrame:
        rows, gone = self.spark.read.schema(SEGMENT).parquet(meta["segment"]), self._gone(meta, 0)
        return rows.withColumn("dead", F.lit(False)) if gone is None else rows.join(gone.withColumn("dead", F.lit(True)), "key", "left").withColumn("dead", F.coalesce("dead", F.lit(False)))

    def vectors(self, name: str) -> DataFrame:
        """(key, vec) of the live rows."""
        meta = self._meta(name)
        return self._graph_rows(meta).where("not dead").select("key", "vec").unionByName(self._delta(meta))

    def count(self, name: str) -> int:
        return self.vectors(name).count()

    def contains(self, name: str, key: int) -> bool:
        return not self.vectors(name).where(F.col("key") == key).isEmpty()

    def get(self, name: str, key: int) -> list[float] | None:
        row = self.vectors(name).where(F.col("key") == key).first()
        return list(row["vec"]) if row else None

    def export_keys(self, name: str, offset: int = 0, limit: int | None = None) -> DataFrame:
        keys = self.vectors(name).select("key").orderBy("key").offset(offset)
        return keys if limit is None else keys.limit(limit)

    def info(self) -> DataFrame:
        """One row per index, with the statistics of every level."""
        rows = []
        for meta in self.metas.values():
            o = meta["options"]
            stored = self.spark.read.schema(SEGMENT).parquet(meta["segment"])
            each = stored.select("level", F.posexplode("neighbors").alias("at", "around")).groupBy("at").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.size("around")).alias("edges")).orderBy("at").collect()
            stats = [(r["nodes"], r["edges"], r["nodes"] * (o["M0"] if r["at"] == 0 else o["M"]), 4 * r["nodes"] * (1 + (o["M0"] if r["at"] == 0 else o["M"]))) for r in each]
            capacity = (stats[0][0] if stats else 0) + sum(self.spark.read.schema("key long, vec array<float>").parquet(p).count() for p, _ in meta["delta"])
            memory = capacity * 4 * (meta["dim"] or 0) + sum(s[3] for s in stats)
            rows.append(("spark_catalog", "default", meta["name"], meta["table"], o["metric"], meta["dim"], self.count(meta["name"]), capacity, memory, len(stats), stats))
        return self.spark.createDataFrame(rows, INFO)

    # --- search -----------------------------------------------------------------------------------------------

    def choose(self, table: str, column: str, metric: str) -> str | None:
        """The first index of a table's column for a metric."""
        return next((m["name"] for m in self.metas.values() if (m["table"], m["column"], m["options"]["metric"]) == (table, column, metric.lower())), None)

    def search_many(self, name: str, queries: DataFrame, query_key: str, query_col: str, k: int, ef_search: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """(query, key, dist, rn) of the k nearest found for every query; distances are exact.  ``allowed`` is a table
        of keys: others are walked through but never returned.  A beam wide enough to cover a part makes the search of
        that part exact.

        Each graph part answers all queries of its blocks; queries are dealt into blocks of bounded size."""
        meta = self._meta(name)
        if not 0 <= k < MAX_K:
            raise ValueError("k must lie between 0 and 2047")
        o = meta["options"]
        ef = ef_search or int(self.settings["hnsw_ef_search"]) or o["ef_search"]
        asked = queries.select(F.col(query_key).cast("long").alias("q"), F.col(query_col).cast("array<double>").alias("qv")).where("qv is not null")
        blocks = 1 + asked.count() // 4096
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
        stored, late_rows = self._graph_rows(meta), self._delta(meta)
        if allowed is not None:
            keys = allowed.select(F.col(allowed.columns[0]).cast("long").alias("key")).distinct()
            stored = stored.join(keys.withColumn("ok", F.lit(True)), "key", "left").withColumn("dead", F.col("dead") | F.col("ok").isNull()).drop("ok")
            late_rows = late_rows.join(keys, "key", "left_semi")
        graph = stored.select("part", each(blocks).alias("block"), "slot", "key", "level", "neighbors", F.col("vec").cast("array<double>").alias("v"), "dead")
        dealt = asked.select(each(meta["parts"]).alias("part"), F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"), F.lit(None).cast("int").alias("slot"), F.col("q").alias("key"),
                             F.lit(None).cast("int").alias("level"), F.lit(None).cast("array<array<int>>").alias("neighbors"), F.col("qv").alias("v"), F.lit(False).alias("dead"))

        def search(table: pa.Table) -> pa.Table:
            asks = table.column("slot").is_null()
            rows, wanted = table.filter(pa.compute.invert(asks)).sort_by("slot"), table.filter(asks)
            out: tuple[list, list] = ([], [])
            if rows.num_rows and wanted.num_rows and k:
                read = lambda t: np.asarray(t.column("v").combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
                if ef * SCAN_SHARE >= rows.num_rows:
                    alive = rows.filter(pa.compute.invert(rows.column("dead")))
                    vectors = read(alive) if alive.num_rows else np.zeros((0, meta["dim"]))
                    held = Candidates(INDEX_METRICS[o["metric"]], vectors, np.ones(alive.num_rows, bool), alive.column("key").to_numpy(), k)
                    near = held.nearest(read(wanted))[0]
                    return pa.table({"q": pa.array(np.repeat(wanted.column("key").to_numpy(), near.shape[1])), "key": pa.array(near.ravel())})
                graph = Graph.load(rows.column("key").to_numpy(), rows.column("level").to_numpy(), rows.column("neighbors").to_pylist(), read(rows), o["metric"], o["M"], o["M0"])
                dead = np.asarray(rows.column("dead"))
                if not dead.any():
                    slots = graph.search_all(read(wanted), k, ef)
                    real = slots < len(graph.keys)
                    asks_for = np.broadcast_to(wanted.column("key").to_numpy()[:, None], slots.shape)
                    return pa.table({"q": pa.array(asks_for[real]), "key": pa.array(graph.keys[slots[real]])})
                for q, v in zip(wanted.column("key").to_pylist(), read(wanted), strict=True):
                    for _, slot in graph.search(v, k, ef, dead if dead.any() else None):
                        out[0].append(q)
                        out[1].append(int(graph.keys[slot]))
            return pa.table({"q": pa.array(out[0], pa.int64()), "key": pa.array(out[1], pa.int64())})

        cells = graph.unionByName(dealt).withColumn("cell", F.col("part") * blocks + F.col("block")).drop("part", "block")
        found = cells.repartitionById(max(meta["parts"], 1) * blocks, F.col("cell")).groupBy("cell").applyInArrow(search, "q long, key long")
        shown = INDEX_METRICS[o["metric"]]
        exact = found.join(self._graph_rows(meta).select("key", "vec"), "key").join(asked, "q")
        exact = exact.select("q", "key", distance(shown, F.col("vec"), F.col("qv"), meta["dim"]).alias("dist"))
        if meta["delta"]:
            late = knn_pairs(asked, "q", "qv", late_rows, "key", "vec", k, shown).select(F.col("o").alias("q"), F.col("i").alias("key"), "dist")
            exact = exact.unionByName(late)
        rn = F.row_number().over(W.partitionBy("q").orderBy(F.col("dist").asc_nulls_last(), "key"))
        return exact.withColumn("rn", rn).where(F.col("rn") <= k).select(F.col("q").alias("query"), "key", "dist", "rn")

    def search(self, df: DataFrame, table: str, column: str, key: str, query, k: int, metric: str = "l2sq", mode: str = "exact", ef_search: int | None = None) -> DataFrame:
        """The k nearest rows of ``df``.  ``mode='ann'`` uses an index of the table, column and metric if there is
        one, and the exact plan if not."""
        name = self.choose(table, column, metric) if mode == "ann" else None
        if name is None:
            return knn_scan(df, column, query, k, key, INDEX_METRICS[metric.lower()])
        asked = self.spark.range(1).select(F.col("id").alias("q"), vector(query).alias("qv"))
        found = self.search_many(name, asked, "q", "qv", k, ef_search).select(F.col("key").alias("_found"), "dist")
        return df.join(found, F.col(key) == F.col("_found")).drop("_found").orderBy("dist", key)

    def describe_plan(self, table: str, column: str, metric: str, k: int, mode: str = "ann") -> str:
        name = self.choose(table, column, metric) if mode == "ann" else None
        return f"HNSW_INDEX_SCAN(index={name}, table={table}, limit={k})" if name else f"TOP_N(table={table}, order={INDEX_METRICS[metric.lower()]}({column}), limit={k})"
