"""Connected components of a distributed edge list by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _with_min(edges: DataFrame, tag: str) -> DataFrame:
    """edges (u, v) with m: the least of u's neighbours and u.

    The minima are written first, so the join has two plain exchanges and
    Spark can split a node with very many edges over tasks.
    """
    m = materialize(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), tag)
    return edges.join(m, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """Component of every node that has an edge.

    ``edges`` has two long columns (u, v); loops and repeats are allowed.
    Returns (node, component), component being the least node reachable. Each
    round is a large-star and a small-star step (Kiveris et al., 2014): edges
    never grow in number, a hub's minimum is pre-aggregated, and the number of
    rounds is logarithmic. No edge reaches the driver, only a count and a hash.
    """
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both, "large").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "star")
        small = _with_min(large, "small").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
