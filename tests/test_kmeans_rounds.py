"""k-means runs to convergence: whole brands in a task, large ones round by round, without a limit of rounds."""

import numpy as np
import pytest

from skufold.operators import cluster
from skufold.operators.cluster import ClusterConfig, cluster_products

POINT = "brandId string, brandSKUId long, embedding array<double>"


def _plain(v, c):
    """Centroids by Lloyd rounds written out, and the number of rounds."""
    done = 0
    while True:
        at = ((v[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([v[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(len(c))])
        done += 1
        if np.sqrt(((new - c) ** 2).sum(axis=1)).max() <= 1e-6:
            return new, done
        c = new


@pytest.mark.parametrize("shape,k", [((400, 5), 12), ((300, 1), 2), ((50, 3), 1), ((30, 2), 30)])
def test_rounds_in_a_task_are_the_plain_ones(shape, k):
    v = np.random.default_rng(2).normal(size=shape)
    c = np.concatenate((v[:k - 1], [v[0] + 50])) if k == 12 else v[:k]  # one centroid without points
    want, done = _plain(v, c.copy())
    got, moving = cluster._lloyd(v, c.copy(), 1e-6)
    assert not moving and np.allclose(got, want, atol=1e-9)
    if done > 2:
        assert cluster._lloyd(v, c.copy(), 1e-6, 1)[1]


def test_more_than_300_rounds(spark):
    """Centroids that start at one end of a line spread over it by little in a round."""
    v = np.column_stack((np.sort(np.random.default_rng(6).uniform(0, 1000, 6000)), np.zeros(6000)))
    c, done = _plain(v, v[:24].copy())
    assert done > 300
    df = spark.createDataFrame([("a", i, x.tolist()) for i, x in enumerate(v)], POINT)
    cfg = ClusterConfig(method="kmeans", k=24, kmeans_n_init=1, kmeans_seeding="first")
    got = {r.brandSKUId: r.cluster_id for r in cluster_products(df, cfg).collect()}
    at = ((v[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert got == {i: int(x) for i, x in enumerate(at)}


@pytest.mark.parametrize("whole", [1 << 26, 0])
def test_whole_and_large_brands_converge(spark, monkeypatch, whole):
    monkeypatch.setattr(cluster, "_WHOLE_BYTES", whole)
    rng = np.random.default_rng(4)
    data = {"a": rng.normal(size=(80, 3)), "b": np.vstack((rng.normal(size=(60, 3)), rng.normal(9, 1, (60, 3))))}
    rows = [(b, i, x.tolist()) for b, v in data.items() for i, x in enumerate(v)] + [("a", 500, None)]
    df = spark.createDataFrame(rows, POINT)
    cfg = dict(method="kmeans", k=3, kmeans_n_init=1, kmeans_seeding="first", rows_per_salt=50)
    got = {(r.brandId, r.brandSKUId): r.cluster_id for r in cluster_products(df, ClusterConfig(**cfg)).collect()}
    assert got.pop(("a", 500)) == -1
    for b, v in data.items():
        c, done = _plain(v, v[:3].copy())
        assert done > 2
        at = ((v[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert {i: int(x) for i, x in enumerate(at)} == {i: x for (g, i), x in got.items() if g == b}
    with pytest.raises(RuntimeError, match="still moves after 2 rounds"):
        cluster_products(df, ClusterConfig(kmeans_max_iter=2, **cfg))
    with pytest.raises(Exception, match="not finite"):
        cluster_products(spark.createDataFrame(rows + [("a", 501, [float("nan")] * 3)], POINT), ClusterConfig(**cfg)).collect()


@pytest.mark.parametrize("whole", [1 << 26, 0])
def test_repeated_and_null_keys_give_one_centroid_each(spark, monkeypatch, whole):
    monkeypatch.setattr(cluster, "_WHOLE_BYTES", whole)
    v = np.random.default_rng(9).normal(size=(60, 2))
    v[1] = v[0] - 1  # of one key, the lesser vector is the first
    keys = [0, 0, None, None, *range(4, 60)]
    df = spark.createDataFrame([("a", k, x.tolist()) for k, x in zip(keys, v)], POINT)
    seeds = np.array([*sorted(v[2:4].tolist()), *sorted(v[:2].tolist()), v[4].tolist()])  # nulls come first
    c, _ = _plain(v, seeds)
    at = ((v[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    cfg = ClusterConfig(method="kmeans", k=5, kmeans_n_init=1, kmeans_seeding="first")
    got = {r.brandSKUId: r.cluster_id for r in cluster_products(df, cfg).collect() if r.brandSKUId}
    assert got == {i: int(at[i]) for i in range(4, 60)}
