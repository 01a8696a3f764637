"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _smallest(pairs: DataFrame) -> DataFrame:
    """Every (u, v) with the smallest of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, root) of every vertex of ``edges`` (u, v): root is the smallest
    vertex of its component.  Each round points all larger neighbours of a
    vertex at the smallest one, then each vertex and its smaller neighbours;
    every round's edges are a stored table, and the rounds grow with the
    logarithm of a component's diameter."""
    def both(e):
        return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stored(e, "edges")
    before = None
    while True:
        large = _smallest(both(e)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = _smallest(large)
        small = small.select("v", "m").unionByName(small.select(F.col("u").alias("v"), "m"))
        e = stored(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct()
    return e.select("u", F.col("v").alias("root")).unionByName(roots)
