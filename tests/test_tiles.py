"""Tiles: blocks are sent once to a tile, and a tile returns what its points need, not its pairs."""

import numpy as np
import pytest

from skufold.operators import mst, pivots
from skufold.operators.cluster import ClusterConfig, density_clusters
from skufold.operators.components import connected_components
from skufold.operators.neighbors import kth_core_distances, mutual_reachability
from skufold.session import saved

SCHEMA = "brandId string, brandSKUId long, embedding array<float>"


@pytest.fixture()
def small_tiles(monkeypatch):
    monkeypatch.setattr(pivots, "LEAST_TILE", 2)
    monkeypatch.setattr(pivots, "MOST_TILE", 2)


def vectors(n=900):
    """Unit vectors without structure (boxes rule out nothing), a few of them equal, and a brand of two."""
    x = np.random.default_rng(5).standard_normal((n, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[n // 2] = x[0]
    return [("g", i, v.tolist()) for i, v in enumerate(x)] + [("two", n, x[1].tolist()), ("two", n + 1, x[1].tolist())]


def distances(rows, brand):
    own = [(k, np.array(v, np.float32).astype(float)) for b, k, v in rows if b == brand]
    x = np.array([v for _, v in own])
    return [k for k, _ in own], np.sqrt(((x[:, None] - x) ** 2).sum(2))


def all_met(index):
    reach = index.blocks.selectExpr("block", "9.0D as r")
    return pivots.near_blocks(index, reach).filter("block <= other")


def test_a_block_is_sent_once_to_a_tile(spark, small_tiles):
    index = pivots.build(spark.createDataFrame(vectors(), SCHEMA), "brandId", "brandSKUId", "embedding")

    def count(met, metric):
        met = list(met)
        return np.array([len(met)]), np.array([len({id(x) for a, b, _ in met for x in (a, b)})])
    tiles = pivots.meet(index, all_met(index), count, "pairs long, sent long", whole=True).collect()
    assert sum(t.pairs for t in tiles) == all_met(index).count()
    assert len(tiles) > 1 and all(t.sent <= 4 for t in tiles)


def test_links_connect_what_pairs_connect(spark, small_tiles):
    rows = vectors()
    index = pivots.build(spark.createDataFrame(rows, SCHEMA), "brandId", "brandSKUId", "embedding")
    key = {r.vid: r.key for r in index.points.collect()}
    n = len(rows)
    for eps, k in ((0.35, 1), (0.6, 3)):
        cores = saved(pivots.kth_distances(index, k).filter(f"core <= {eps}")) if k > 1 else None
        links = saved(pivots.links_within(index, eps, cores))
        pairs = pivots.pairs_within(index, eps, "long", cores)
        got = {key[r.vertex]: key[r.component] for r in connected_components(links, "a", "b").collect()}
        want = {r.vertex: r.component for r in connected_components(pairs, "a", "b").collect()}
        assert got == want and len(want) > 50
        assert links.count() <= n * index.tiles.select("tile").distinct().count()


@pytest.mark.parametrize("k", [1, 3])
def test_mutual_reachability_against_brute_force(spark, small_tiles, k):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA)
    want, cores = {}, {}
    for brand in ("g", "two"):
        keys, d = distances(rows, brand)
        if len(keys) <= k:  # fewer neighbours than k: no core distance, no pair
            continue
        core = np.sort(d + np.diag([np.inf] * len(d)), axis=1)[:, k - 1]
        cores |= {key: c for key, c in zip(keys, core)}
        want |= {(keys[i], keys[j]): max(core[i], core[j], d[i, j])
                 for i, j in zip(*np.nonzero(np.triu(d <= 0.5, 1)))}
    got = {(r.a, r.b): r.mr for r in mutual_reachability(df, 0.5, k).collect()}
    found = {r.id: r.core for r in kth_core_distances(df, k).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    assert found.keys() == cores.keys() and all(abs(found[x] - cores[x]) < 1e-9 for x in cores)


def test_a_search_returns_a_row_per_point_and_tile(spark, small_tiles):
    index = pivots.build(spark.createDataFrame(vectors(), SCHEMA), "brandId", "brandSKUId", "embedding")
    look = index.points.selectExpr("vid", "block", "pos", "0.0D as core", "vid as comp", "9.0D as reach")
    states = mst._states(look, "core", "comp", "reach")
    pairs = pivots.near_blocks(index, index.blocks.selectExpr("block", "9.0D as r"))
    rows = pivots.meet(index, pairs, mst._search, mst.FOUND, states, whole=True)
    tiles = index.tiles.select("tile").distinct().count()
    seen = rows.groupBy("vid").count().collect()
    assert len(seen) == len(vectors()) and max(r["count"] for r in seen) <= tiles < index.blocks.count()


def test_a_repeated_key_has_all_its_core_distances(spark):
    """A key with two core distances gives each of its pairs a row for either."""
    rows = [("g", 1, [0.0, 0.0]), ("g", 1, [1.0, 0.0]), ("g", 2, [0.0, 0.5]), ("g", 3, [5.0, 5.0])]
    got = sorted((r.a, r.b, round(r.mr, 6)) for r in mutual_reachability(spark.createDataFrame(rows, SCHEMA), 0.6, 1).collect())
    assert got == [(1, 2, 0.5), (1, 2, 1.0)]


def test_points_of_one_key_are_one_vertex(spark):
    """Two vectors of a key join what lies near either; no row is multiplied."""
    rows = [("g", 1, [0.0, 0.0]), ("g", 1, [9.0, 0.0]), ("g", 2, [0.1, 0.0]), ("g", 3, [9.1, 0.0]), ("g", 4, [5.0, 5.0])]
    found = density_clusters(spark.createDataFrame(rows, SCHEMA), ClusterConfig(epsilon=0.2))
    # the last step joins by vector: one row per vector that a key's rows have in the cluster
    assert {(r.brandSKUId, r.cluster_id) for r in found.collect()} == {(1, 0), (2, 0), (3, 0), (4, -1)}
