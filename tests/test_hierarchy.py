"""Pivot blocks, exact k-th distances, spanning trees and hierarchical clusters against
brute force."""

import math

import numpy as np
import pytest

from skufold.operators import hierarchy, mst, pivots
from skufold.operators.cluster import ClusterConfig, hdbscan_clusters
from skufold.operators.neighbors import eps_pairs
from skufold.session import saved

SCHEMA = "brandId string, brandSKUId long, embedding array<double>"


def blobs(seed, sizes, dim=4, spread=0.05, copies=0, noise=6):
    rng = np.random.default_rng(seed)
    rows = [c + spread * rng.standard_normal(dim) for c in rng.uniform(-1, 1, (len(sizes), dim)) for _ in range(sizes.pop(0))]
    rows += list(rng.uniform(-1.5, 1.5, (noise, dim)))
    rows += [rows[0]] * copies
    return [x.tolist() for x in rows]


def frame(spark, by_brand):
    rows, key = [], 0
    for g, vectors in by_brand.items():
        for v in vectors:
            rows.append((g, key, v))
            key += 1
    return rows, spark.createDataFrame(rows, SCHEMA)


def brute_cores(x, k, metric="euclidean"):
    d = np.abs(x[:, None] - x).sum(2) if metric == "manhattan" else np.sqrt(((x[:, None] - x) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    core = np.sort(d, axis=1)[:, k - 1] if len(x) > k else np.full(len(x), np.inf)
    return d, core


def brute_tree(x, k, metric="euclidean"):
    """Kruskal over all pairs by (mutual reachability, smaller id, larger id)."""
    d, core = brute_cores(x, k, metric)
    edges = sorted((max(d[i, j], core[i], core[j]), i, j) for i in range(len(x)) for j in range(i + 1, len(x)))
    at, out = list(range(len(x))), []
    for w, i, j in edges:
        if at[i] != at[j] and w < np.inf:
            old, new = at[i], at[j]
            at = [new if a == old else a for a in at]
            out.append((w, i, j))
    return out, core


def brute_labels(x, k, mcs, epsilon):
    """Published procedure on the single-linkage tree: condense, excess of mass, epsilon."""
    tree, _ = brute_tree(x, k)
    n = len(x)
    if not tree:
        return [-1] * n
    part = {i: (i,) for i in range(n)}
    at = list(range(n))
    node, kids, lam = n, {}, {}
    members = {i: [i] for i in range(n)}
    for w, i, j in tree:
        a, b = at[i], at[j]
        kids[node], lam[node] = (a, b), (1 / w if w > 0 else math.inf)
        members[node] = members[a] + members[b]
        for m in members[node]:
            at[m] = node
        node += 1
    root = node - 1
    clusters, fell = {0: [None, 0.0, 0.0, []]}, {}  # parent, birth, stability, children
    todo = [(root, 0)]
    if len(members[root]) < mcs:
        return [-1] * n
    while todo:
        x_, c = todo.pop()
        if x_ < n:
            fell[x_] = c
            continue
        a, b = kids[x_]
        big = [len(members[y]) >= mcs for y in (a, b)]
        drop = lambda size: 0.0 if lam[x_] <= clusters[c][1] else size * (lam[x_] - clusters[c][1])
        for y, ok in zip((a, b), big):
            if all(big):
                clusters[c][2] += drop(len(members[y]))
                new = len(clusters)
                clusters[new] = [c, lam[x_], 0.0, []]
                clusters[c][3].append(new)
                todo.append((y, new))
            elif ok:
                todo.append((y, c))
            else:
                clusters[c][2] += drop(len(members[y]))
                for m in members[y]:
                    fell[m] = c
    best, total = {}, {}
    for c in sorted(clusters, reverse=True):
        below = sum(total[y] for y in clusters[c][3])
        best[c] = c != 0 and (not clusters[c][3] or clusters[c][2] >= below)
        total[c] = max(clusters[c][2], below) if clusters[c][3] else clusters[c][2]
    up = lambda c: [] if c is None else [c, *up(clusters[c][0])]
    chosen = {c for c in clusters if best[c] and not any(best[a] for a in up(clusters[c][0]))}
    eps = lambda c: 1 / clusters[c][1] if clusters[c][1] > 0 else math.inf
    final = set()
    for c in chosen:
        if epsilon > 0 and eps(c) < epsilon:
            while clusters[c][0] != 0 and (eps(c) <= epsilon):
                c = clusters[c][0]
        final.add(c)
    label = {p: next((a for a in up(c) if a in final), None) for p, c in fell.items()}
    least = {}
    for p in sorted(label):
        if label[p] is not None:
            least.setdefault(label[p], len(least))
    return [least.get(label[p], -1) if label[p] is not None else -1 for p in range(n)]


CASES = {
    "a": blobs(1, [40, 30, 25, 8, 3]), "b": blobs(2, [12, 9], copies=5), "c": blobs(3, [60, 5], spread=0.2, noise=20),
    "one": [[1.0, 2.0, 3.0, 4.0]], "two": [[0.0] * 4, [1.0] * 4], "same": [[1.0, 1.0, 1.0, 1.0]] * 6,
    "grid": [[float(i), float(j), 0.0, 0.0] for i in range(6) for j in range(6)],  # ties everywhere
}


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 8)
    monkeypatch.setattr(pivots, "SUPER", 3)
    monkeypatch.setattr(pivots, "ROWS_PER_SALT", 32)


@pytest.mark.parametrize("k,metric", [(3, "manhattan")])
def test_kth_distances_and_trees(spark, small_blocks, k, metric):
    rows, df = frame(spark, CASES)
    index = pivots.build(df, "brandId", "brandSKUId", "embedding", metric)
    keys = {r.vid: r.key for r in index.points.collect()}
    cores = saved(pivots.kth_distances(index, k))
    got = {keys[r.vid]: r.core for r in cores.collect()}
    edges = {(keys[r.lo], keys[r.hi]): r.w for r in mst.spanning_trees(index, cores).collect()}
    want_cores, want_edges = {}, {}
    for g in CASES:
        own = [(key, v) for b, key, v in rows if b == g]
        tree, core = brute_tree(np.array([v for _, v in own]), k, metric)
        want_cores |= {key: c for (key, _), c in zip(own, core) if c < np.inf}
        want_edges |= {(own[i][0], own[j][0]): w for w, i, j in tree}
    assert got.keys() == want_cores.keys() and all(abs(got[x] - want_cores[x]) < 1e-12 for x in got)
    assert edges.keys() == want_edges.keys()
    assert all(abs(edges[x] - want_edges[x]) < 1e-12 for x in edges)


@pytest.mark.parametrize("k,mcs,epsilon", [(2, 4, 0.3)])
def test_labels(spark, small_blocks, k, mcs, epsilon):
    rows, df = frame(spark, CASES)
    cfg = ClusterConfig(method="hdbscan", min_cluster_size=mcs, min_samples=k, epsilon=epsilon)
    got = {r.brandSKUId: r.cluster_id for r in hdbscan_clusters(df, cfg).collect()}
    assert len(got) == len(rows)
    for g in CASES:
        if g == "grid":  # all weights tie: any order of merging is right
            continue
        own = [(key, v) for b, key, v in rows if b == g]
        want = brute_labels(np.array([v for _, v in own]), k, mcs, epsilon)
        assert [got[key] for key, _ in own] == want, g


def test_merge_tree_of_a_path_and_a_star(spark):
    """Depth far above the number of rounds, and one part with everything."""
    edges = [(float(i + 1), i, i + 1) for i in range(200)] + [(float(i), 300, 300 + i) for i in range(1, 100)]
    leaves = [(i, 1) for i in [*range(201), *range(300, 400)]]
    t = hierarchy.merge_tree(spark.createDataFrame(edges, "w double, lo long, hi long"),
                             spark.createDataFrame(leaves, "vid long, copies long")).collect()
    inner = {r.id: r for r in t if r.id >= 0}
    assert len(t) == len(edges) + len(leaves) and sum(r.parent is None for r in t) == 2
    assert sorted(r.size for r in inner.values()) == sorted([*range(2, 202), *range(2, 101)])
    assert all(r.up is None or r.w is None or r.up >= r.w for r in t)


def test_blocks_rule_out_most_pairs(spark):
    """20,000 clustered points of one brand: few pairs are compared, all near ones found."""
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((200, 16))
    x = np.repeat(centres, 100, axis=0) + 0.01 * rng.standard_normal((20_000, 16))
    df = spark.createDataFrame([("g", i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    index = pivots.build(df, "brandId", "brandSKUId", "embedding")
    sizes = {r.block: r.n for r in index.blocks.selectExpr("block", "size(vids) as n").collect()}
    reach = index.blocks.selectExpr("block", "0.2 as r")
    near = pivots.near_blocks(index, reach).filter("block <= other").collect()
    compared = sum(sizes[r.block] * sizes[r.other] for r in near)
    assert compared < 0.05 * 20_000 ** 2 / 2
    want = sum(int((np.sqrt(((x[i:i + 100, None] - x[i:i + 100]) ** 2).sum(2)) <= 0.2).sum()) - 100
               for i in range(0, 20_000, 100)) // 2
    assert eps_pairs(df, 0.2).count() == want
