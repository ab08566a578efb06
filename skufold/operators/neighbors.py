"""Exact epsilon-neighbour pairs, core distances and mutual reachability.

Pairs come from the pivot blocks of ``pivots``: distance boxes rule pairs of blocks
out before any vector is fetched, the rest is compared densely and exactly. Both
metrics (euclidean, manhattan) obey the triangle inequality. Nothing is sampled or
capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import saved
from . import pivots



def eps_pairs(points: DataFrame, eps: float, group: str = "brandId", key: str = "brandSKUId",
              vec: str = "embedding", metric: str = "euclidean") -> DataFrame:
    """All pairs (a < b) in the same group with distance <= eps, as (group, a, b, d)."""
    index = pivots.build(points, group, key, vec, metric)
    found = pivots.pairs_within(index, eps, dict(index.points.dtypes)["key"])
    return found.select(F.col("g").alias(group), "a", "b", "d")


def kth_core_distances(points: DataFrame, k: int, group: str = "brandId", key: str = "brandSKUId",
                       vec: str = "embedding", metric: str = "euclidean") -> DataFrame:
    """(group, id, core), each point's exact distance to its k-th nearest other
    point of the group; points with fewer others have no row."""
    index = pivots.build(points, group, key, vec, metric)
    named = index.points.select(F.col("g").alias(group), F.col("key").alias("id"), "vid")
    return named.join(pivots.kth_distances(index, k), "vid").select(group, "id", "core")


def mutual_reachability(points: DataFrame, eps: float, k: int, group: str = "brandId", key: str = "brandSKUId",
                        vec: str = "embedding", metric: str = "euclidean") -> DataFrame:
    """(group, a, b, d, mr) of all pairs at most eps apart whose points have a core
    distance to the k-th neighbour; mr is taken where the vectors meet, no pair is joined."""
    index = pivots.build(points, group, key, vec, metric)
    cores = pivots.kth_distances(index, k).transform(saved)
    found = pivots.pairs_within(index, eps, dict(index.points.dtypes)["key"], cores)
    return found.select(F.col("g").alias(group), "a", "b", "d", "mr")


def both_directions(pairs: DataFrame, group: str = "brandId") -> DataFrame:
    return pairs.select(group, "a", "b", "d").union(
        pairs.select(group, F.col("b").alias("a"), F.col("a").alias("b"), "d"))


def core_distances(pairs: DataFrame, min_samples: int = 1, group: str = "brandId",
                   weights: DataFrame | None = None) -> DataFrame:
    """Distance to the k-th nearest other point, k = min_samples, for points
    whose k-th neighbour lies within eps; the others have core distance > eps and
    drop out. Returns (group, id, core).

    ``weights`` (group, id, copies) gives the points a vertex stands for: its
    further copies are neighbours at distance 0. The window is per point over its
    eps-neighbours only, never over a brand.
    """
    both = both_directions(pairs, group).withColumn("copies", F.lit(1).cast("long"))
    if weights is not None:
        w = weights.select(group, "id", F.col("copies").cast("long"))
        own = w.filter("copies > 1").select(group, F.col("id").alias("a"), F.col("id").alias("b"),
                                            F.lit(0.0).alias("d"), (F.col("copies") - 1).alias("copies"))
        both = (both.drop("copies").join(w.withColumnRenamed("id", "b"), [group, "b"])
                .select(group, "a", "b", "d", "copies").union(own))
    run = Window.partitionBy(group, "a").orderBy("d", "b").rowsBetween(Window.unboundedPreceding, 0)
    ranked = both.withColumn("_rn", F.sum("copies").over(run)).filter(F.col("_rn") >= int(min_samples))
    return ranked.groupBy(group, F.col("a").alias("id")).agg(F.min("d").alias("core"))


def mutual_reachability_edges(pairs: DataFrame, cores: DataFrame | None, eps: float | None = None,
                              group: str = "brandId") -> DataFrame:
    """mr = max(core a, core b, d), of all pairs or of those with mr <= eps. With
    min_samples = 1 every core distance is <= d, so mr = d and no core join is needed."""
    if cores is None:
        return pairs.withColumn("mr", F.col("d"))
    ca = cores.select(group, F.col("id").alias("a"), F.col("core").alias("ca"))
    cb = cores.select(group, F.col("id").alias("b"), F.col("core").alias("cb"))
    e = pairs.join(ca, [group, "a"]).join(cb, [group, "b"]).withColumn("mr", F.greatest("ca", "cb", "d"))
    return e if eps is None else e.filter(F.col("mr") <= float(eps))
