"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage


def connected_components(edges: DataFrame, most: int = 60, save: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """(v, component) for the vertices of edges (a, b); a component is named by its least vertex.

    Each round is written, so lineage stays short; the number of rounds grows with the logarithm of the number of
    vertices.  save: writes the edges of a round and reads them back; by default they are staged.
    """
    save = save or (lambda df, _: stage(df, "edges"))
    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), 0)
    before = None
    for k in range(1, most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        # small star: every smaller neighbour and the vertex itself hang on the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = save(low.select("a", F.col("m").alias("b")).unionByName(small).where("a <> b").distinct(), k)
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if mark == before:
            ends = now.select(F.col("a").alias("v"), F.col("b").alias("component"))
            return ends.unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("component")).distinct())
        before = mark
    raise RuntimeError("components did not settle")
