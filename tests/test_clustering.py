"""Clustering: exact eps pairs vs brute force, density cut vs FIXTURES,
k-means properties, components."""

import math

import pytest
from pyspark.sql import functions as F

from skufold.operators.cluster import ClusterConfig, cluster_products
from skufold.operators.components import connected_components
from skufold.operators.neighbors import eps_pairs
from skufold.plans import flows

from .conftest import SF01


def test_eps_pairs_exact_vs_brute_force(spark):
    pts = flows.embedding_points(spark, SF01)
    rows = pts.collect()
    by = {}
    for r in rows:
        by.setdefault(r.brandId, []).append((r.brandSKUId, [float(x) for x in r.embedding]))
    brute = set()
    for b, items in by.items():
        for i, (ia, va) in enumerate(items):
            for ib, vb in items:
                if ia < ib and math.sqrt(sum((x - y) ** 2 for x, y in zip(va, vb))) <= 1.2:
                    brute.add((b, ia, ib))
    got = {(r.brandId, r.a, r.b) for r in eps_pairs(pts, 1.2).collect()}
    assert got == brute and len(got) > 0


@pytest.mark.parametrize("eps,ms,clusters,clustered,largest", [
    (1.2, 1, 70, 230, 12),
    (1.25, 3, 15, 169, 33),
])
def test_density_cut_matches_fixture(spark, eps, ms, clusters, clustered, largest):
    r = flows.embedding_clusters(spark, SF01, eps, ms)
    c = r.filter("cluster_id >= 0").groupBy("brandId", "cluster_id").count()
    assert c.count() == clusters
    assert r.filter("cluster_id >= 0").count() == clustered
    assert c.agg(F.max("count")).first()[0] == largest
    assert r.count() == 500  # every SKU exactly once


def test_connected_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (5, 4), (4, 3)], "src long, dst long")
    got = {r.vertex: r.component for r in connected_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10}


def test_kmeans_separated_blobs(spark):
    import random
    rnd = random.Random(7)
    centers = [[10.0 * i, -5.0 * i, 3.0] for i in range(3)]
    rows = []
    k = 0
    for b in ("x", "y"):
        for ci, c in enumerate(centers):
            for _ in range(15):
                rows.append((b, k, [v + rnd.uniform(-0.1, 0.1) for v in c], ci))
                k += 1
    df = spark.createDataFrame(rows, "brandId string, brandSKUId long, embedding array<double>, truth int")
    # force k-means; k = min(max(45 // 20, 10), 100) clamped to n -> 10 clusters per brand
    out = cluster_products(df.select("brandId", "brandSKUId", "embedding"), ClusterConfig(method="kmeans"))
    j = out.join(df, ["brandId", "brandSKUId"])
    assert out.count() == len(rows) and out.filter("cluster_id < 0").count() == 0
    # no k-means cluster mixes two true blobs
    mixed = j.groupBy("brandId", "cluster_id").agg(F.count_distinct("truth").alias("t")).filter("t > 1").count()
    assert mixed == 0
