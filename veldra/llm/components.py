"""Connected components of an edge table by contraction, without collecting edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


#: Edges that one task takes: a table of no more needs no shuffles.
FEW_EDGES = 20_000


def contract(edges: DataFrame) -> DataFrame:
    """(old, new): for each label that occurs in ``edges(a long, b long)``, the smallest label it is connected with.

    Every round hooks each label to its smallest neighbour, shortens the hooks by pointer jumping and relabels the
    edges; edges inside a component drop out, so the table shrinks until it is empty.  Each round's tables are
    written to the shared folder.
    """
    spark = edges.sparkSession
    live = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    known: DataFrame | None = None
    while count := live.count():
        # the tables of a few edges fit one task, where joins and sums need no exchange
        near = (lambda df: df.coalesce(1)) if count <= FEW_EDGES else (lambda df: df)
        one = near(live)
        both = near(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        hook = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p"))
        for _ in range(2):
            up = hook.select(F.col("a").alias("p"), F.col("p").alias("q"))
            hook = hook.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
        written = materialize(hook, "hooks")
        hook = near(written)
        names = hook.select(F.col("a").alias("new"), "p")
        before, old = known, live
        if known is None:
            known = hook.select(F.col("a").alias("old"), F.col("p").alias("new"))
        else:
            known = known.join(names, "new", "left").select("old", F.coalesce("p", "new").alias("new"))
        known = materialize(known, "labels")
        left, right = hook.select("a", F.col("p").alias("x")), hook.select(F.col("a").alias("b"), F.col("p").alias("y"))
        moved = one.join(left, "a").join(right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        live = materialize(moved.distinct(), "edges")
        discard(before, old, written)
    discard(live)
    return known if known is not None else spark.createDataFrame([], "old long, new long")
