"""Connected components over an edge DataFrame, distributed and exact.

Alternating large-star / small-star contraction: an edge always points from a
vertex to a smaller one; every round re-hangs the neighbours of each vertex
below the smallest vertex they know, until the edge set is a forest of stars
whose centres are the smallest vertices of the components. The number of rounds
grows with the logarithm of a component's size (a path of n vertices included),
there is no round limit, and the loop ends only at the fixed point.

A hub's minimum is a partial aggregate; handing it back to the hub's edges is a
plain shuffle join, which adaptive execution splits when a hub is hot. Every
round is written with ``checkpoint()`` into the shared ``spark.checkpoint.dir``,
so a lost executor repeats at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.when(F.col("m") < F.col("u"), F.col("m")).otherwise(F.col("u")).alias("m"))
    return (both.join(low, "u").filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = (e.join(low, "u").filter(F.col("v") != F.col("m"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """edges(src, dst) -> (vertex, component) with component = min vertex.

    Vertices may be of any orderable type, structs such as (brand, sku)
    included. Self-loops and edges with a null end are ignored; only vertices
    that appear in an edge with another vertex are returned.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    a, b = F.col(src), F.col(dst)
    e = (edges.filter(a != b)
         .select(F.when(a > b, a).otherwise(b).alias("u"), F.when(a > b, b).otherwise(a).alias("v"))
         .distinct())
    e = e.checkpoint()
    seen = _state(e)
    while seen[0]:
        e = _small_star(_large_star(e)).checkpoint()
        now = _state(e)
        if now == seen:
            break
        seen = now
    tops = e.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(tops)


def _state(e: DataFrame) -> tuple:
    """Two order-free digests and the size of the edge set: equal states mean
    that a round changed nothing."""
    r = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("v", "u"))).first()
    return tuple(r)
