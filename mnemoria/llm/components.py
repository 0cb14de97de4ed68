"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(id, component)`` of every id in ``edges(a, b)``; ``component`` is the smallest id reachable.

    Alternating large-star and small-star steps on tables written to the shared folder; each step
    replaces edges by edges towards smaller ids and stops when nothing changes. Every grouping is a
    minimum with map-side combination, written before the edges are joined with it: both sides of the
    join are then plain scans, and Spark's adaptive skew join splits the edges of a vertex that has very many.
    Only the number of edges and a checksum reach the driver. Loops are dropped; an empty table of
    edges gives an empty one.
    """
    current = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    current = materialize(current, name)
    before = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), name)
        # Large star: neighbours above u move to the smallest of u's neighbourhood.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, name)
        # Small star: u and its neighbours below move to the smallest of them.
        smallest = materialize(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(smallest, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        current = materialize(small, name)
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31)).alias("h")).first()
        now = (state["n"], state["h"])
        if now == before:
            break
        before = now
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
