"""Approximate nearest neighbours by cosine: one HNSW graph per shard.

Vectors are dealt to shards by hash; equal vectors are one node that lists its
smallest ids, so a vector that a third of all rows hold is no swamp of equal
neighbours. A shard's graph is one row of flat arrays: per layer the nodes and
their neighbours, padded to a fixed width. Nodes are inserted from the highest
layer down in waves: each wave searches the graph so far (all its members in
step, as numpy array work), adds its own members as candidates, picks diverse
neighbours and links back, pruning full lists by the same rule. Queries go to
every shard in blocks, some blocks to each copy of its graph; the shards' results are
merged by exact cosine.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Neighbours per node above layer 0 and on it; beam of insertion and of search.
M, M0, BUILD_BEAM, SEARCH_BEAM = 16, 32, 96, 128
#: Distinct vectors of a shard, queries of a block, and nodes of a wave at most.
SHARD_ROWS, QUERY_BLOCK, WAVE = 8192, 1024, 256
#: Blocks of queries that meet a graph at once: about as many queries as it has vectors.
BLOCKS_AT_ONCE = 8


@dataclass
class Layer:
    nodes: np.ndarray      # node numbers on this layer, in insertion order
    neighbours: np.ndarray  # (all nodes, width) int32, -1 where empty

    def flat(self) -> tuple[bytes, bytes]:
        return self.nodes.astype("<i4").tobytes(), self.neighbours[self.nodes].astype("<i4").tobytes()


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int
                ) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of many queries in step on one layer.

    x: unit vectors; entry: (queries, e) start nodes, -1 where empty. Returns the
    ``beam`` best nodes per query (-1 where fewer) and their cosines, best first.
    """
    b = len(q)
    ids = np.full((b, beam), -1, dtype=np.int32)
    sims = np.full((b, beam), -np.inf, dtype=np.float32)
    open_ = np.zeros((b, beam), dtype=bool)
    seen = np.zeros((b, len(x)), dtype=bool)
    e = min(entry.shape[1], beam)
    ids[:, :e] = entry[:, :e]
    s = np.einsum("bed,bd->be", x[np.maximum(entry[:, :e], 0)], q)
    sims[:, :e] = np.where(entry[:, :e] >= 0, s, -np.inf)
    open_[:, :e] = entry[:, :e] >= 0
    rows = np.repeat(np.arange(b), e)
    flat = entry[:, :e].ravel()
    seen[rows[flat >= 0], flat[flat >= 0]] = True
    live = np.arange(b)
    while len(live):
        best = np.where(open_[live], sims[live], -np.inf)
        at = best.argmax(axis=1)
        some = best[np.arange(len(live)), at] > -np.inf
        live, at = live[some], at[some]
        if not len(live):
            break
        open_[live, at] = False
        near = links[ids[live, at]]
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        got = np.full(near.shape, -np.inf, dtype=np.float32)
        got[r, c] = np.einsum("nd,nd->n", x[near[r, c]], q[live[r]])
        all_sims = np.hstack((sims[live], got))
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        sims[live] = np.take_along_axis(all_sims, top, 1)
        ids[live] = np.take_along_axis(np.hstack((ids[live], near)), top, 1)
        open_[live] = np.take_along_axis(np.hstack((open_[live], fresh)), top, 1)
    ids[sims == -np.inf] = -1
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def choose(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
    """Diverse neighbours: a candidate (best first) is taken if it is nearer to the
    node than to every one taken before; free places go to the nearest others."""
    b, c = cand.shape
    real = (cand >= 0) & (sims > -np.inf)
    vec = x[np.maximum(cand, 0)]
    between = vec @ vec.transpose(0, 2, 1)
    nearest = np.full((b, c), -np.inf, dtype=np.float32)
    taken = np.zeros((b, c), dtype=bool)
    count = np.zeros(b, dtype=np.int64)
    for j in range(c):
        take = real[:, j] & (count < width) & (sims[:, j] > nearest[:, j])
        taken[:, j] = take
        count += take
        nearest = np.where(take[:, None], np.maximum(nearest, between[:, j]), nearest)
    rank = np.where(taken, 0, np.where(real, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, axis=1, kind="stable")[:, :width]
    out = np.where(np.take_along_axis(real, order, 1), np.take_along_axis(cand, order, 1), -1)
    if out.shape[1] < width:
        out = np.hstack((out, np.full((b, width - out.shape[1]), -1, dtype=out.dtype)))
    return out.astype(np.int32)


def _link_back(x: np.ndarray, links: np.ndarray, wave: np.ndarray) -> None:
    """Add wave's nodes to the lists of their neighbours; full lists are pruned."""
    width = links.shape[1]
    src = np.repeat(wave, width)
    dst = links[wave].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    keep = ~(links[dst] == src[:, None]).any(axis=1)
    src, dst = src[keep], dst[keep]
    if not len(dst):
        return
    order = np.lexsort((src, dst))
    src, dst = src[order], dst[order]
    targets, first, n = np.unique(dst, return_index=True, return_counts=True)
    extra = np.full((len(targets), int(n.max())), -1, dtype=np.int32)
    extra[np.repeat(np.arange(len(targets)), n), np.arange(len(dst)) - np.repeat(first, n)] = src
    both = np.hstack((links[targets], extra))
    fits = (both >= 0).sum(axis=1) <= width
    packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
    links[targets[fits]] = packed[fits, :width]
    for i in range(0, int((~fits).sum()), 512):
        t, cand = targets[~fits][i:i + 512], packed[~fits][i:i + 512]
        sims = np.einsum("bcd,bd->bc", x[np.maximum(cand, 0)], x[t])
        sims = np.where(cand >= 0, sims, -np.inf).astype(np.float32)
        o = np.argsort(-sims, axis=1, kind="stable")
        links[t] = choose(x, np.take_along_axis(cand, o, 1), np.take_along_axis(sims, o, 1), width)


def build(vectors: np.ndarray, seed: int = 11) -> list[Layer]:
    """Layers of the graph, the lowest first; vectors in a fixed order."""
    n = len(vectors)
    x = unit(vectors)
    level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(M)).astype(int), 12)
    order = np.lexsort((np.arange(n), -level))
    layers = [Layer(order[level[order] >= i], np.full((n, M0 if i == 0 else M), -1, dtype=np.int32))
              for i in range(int(level.max()) + 1)]
    done = 1
    while done < n:
        wave = order[done:done + max(1, min(WAVE, done))]
        # a wave stays on one level, so that all of it walks the same layers
        wave = wave[level[wave] == level[wave[0]]]
        entry = np.full((len(wave), 1), order[0], dtype=np.int32)
        for i in range(len(layers) - 1, -1, -1):
            links, own = layers[i].neighbours, level[wave[0]] >= i
            if i > level[order[0]]:
                continue
            ids, sims = beam_search(x, links, x[wave], entry, BUILD_BEAM if own else 1)
            entry = ids[:, :max(1, min(8, ids.shape[1]))]
            if not own:
                continue
            inside = x[wave] @ x[wave].T
            np.fill_diagonal(inside, -np.inf)
            cand = np.hstack((ids, np.broadcast_to(wave.astype(np.int32), inside.shape)))
            sims = np.hstack((sims, inside.astype(np.float32)))
            top = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
            links[wave] = choose(x, np.take_along_axis(cand, top, 1), np.take_along_axis(sims, top, 1), links.shape[1])
            _link_back(x, links, wave)
        done += len(wave)
    return layers


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)


def search(vectors: np.ndarray, layers: list[Layer], queries: np.ndarray, beam: int) -> np.ndarray:
    """Node numbers, best first, -1 where fewer."""
    x, q = unit(vectors), unit(queries)
    entry = np.full((len(q), 1), layers[-1].nodes[0], dtype=np.int32)
    for i in range(len(layers) - 1, -1, -1):
        ids, _ = beam_search(x, layers[i].neighbours, q, entry, beam if i == 0 else 8)
        entry = ids
    return ids


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, dim): rows with an id and a finite, complete, non-zero vector."""
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    v = F.col(vector_col)
    good = (F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, bad)
            & F.exists(v, lambda e: e != 0))
    return (table.filter(good).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
            .withColumn("dim", F.size("v")))


def build_shards(rows: DataFrame, ids_kept: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """(vec_id, v, dim) -> one row per shard and dimension, written once:
    shard, dim, graph (flat arrays); and the number of shards."""
    w = Window.partitionBy("v").orderBy("vec_id")
    few = (rows.distinct().withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= ids_kept))
    nodes = written(few.groupBy("v", "dim").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    shards = max(1, math.ceil(nodes.count() / shard_rows))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))

    def make(t: pa.Table) -> pa.Table:
        dim = t["dim"][0].as_py()
        ids = t["ids"].combine_chunks()
        lens, flat = np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy()
        v = t["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        starts = np.concatenate(([0], np.cumsum(lens)))
        order = np.argsort(flat[starts[:-1]], kind="stable")
        v = v[order]
        graph = {"ids": [flat[starts[i]:starts[i + 1]].astype("<i8").tobytes() for i in order],
                 "vectors": v.astype("<f8").tobytes(), "layers": [x.flat() for x in build(v)]}
        return pa.table([t["shard"][:1], t["dim"][:1], pa.array([pickle.dumps(graph)], pa.binary())],
                        names=["shard", "dim", "graph"])
    return written(dealt.groupBy("shard", "dim").applyInArrow(make, "shard int, dim int, graph binary")), shards


def _loaded(raw: bytes, dim: int) -> tuple[list[np.ndarray], np.ndarray, list[Layer]]:
    g = pickle.loads(raw)
    v = np.frombuffer(g["vectors"], dtype="<f8").reshape(-1, dim)
    layers = []
    for i, (nodes, links) in enumerate(g["layers"]):
        width, at = (M0 if i == 0 else M), np.frombuffer(nodes, dtype="<i4")
        full = np.full((len(v), width), -1, dtype=np.int32)
        full[at] = np.frombuffer(links, dtype="<i4").reshape(-1, width)
        layers.append(Layer(at, full))
    return [np.frombuffer(x, dtype="<i8") for x in g["ids"]], v, layers


def nearest(table: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of table to each row of
    queries, itself (its id) left out; fewer if there are fewer.

    Rows with a null id, or a vector that is null, zero or holds null or
    non-finite components, take no part; equal rows count once; vectors are
    compared with those of their own length. The score is the cosine of the
    original vectors in double precision, ties go to the smaller id. Other columns
    are not read; without rows or queries the result is empty.
    """
    rows = usable(table, id_col, vector_col)
    graphs, shards = build_shards(rows, k + 1, shard_rows)
    asked = usable(queries, id_col, vector_col).distinct()
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))

    def pack(t: pa.Table) -> pa.Table:
        v = t["v"].combine_chunks().flatten().to_numpy()
        return pa.table([t["block"][:1], t["dim"][:1],
                         pa.array([t["vec_id"].combine_chunks().to_numpy().astype("<i8").tobytes()], pa.binary()),
                         pa.array([v.astype("<f8").tobytes()], pa.binary())], names=["block", "dim", "ids", "vectors"])
    packed = (asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
              .groupBy("block", "dim").applyInArrow(pack, "block int, dim int, ids binary, vectors binary"))
    # a co-group is shuffled whatever the sizes; a join's smaller side, all queries times all shards, goes over the driver
    parts = math.ceil(blocks / BLOCKS_AT_ONCE)
    sent = (packed.withColumn("part", F.floor(F.col("block") / BLOCKS_AT_ONCE).cast("int"))
            .select("dim", "part", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "ids", "vectors"))
    copies = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keys = ["shard", "dim", "part"]

    def run(graph: pa.Table, asked: pa.Table) -> pa.Table:
        cols = [], [], []
        if len(graph) and len(asked):
            dim = graph["dim"][0].as_py()
            node_ids, v, layers = _loaded(graph["graph"][0].as_py(), dim)
            norms = np.linalg.norm(v, axis=1)
            for ids, vectors in zip(asked["ids"], asked["vectors"]):
                own, q = np.frombuffer(ids.as_buffer(), dtype="<i8"), np.frombuffer(vectors.as_buffer(), dtype="<f8").reshape(-1, dim)
                for i in range(0, len(q), WAVE):
                    found = search(v, layers, q[i:i + WAVE], beam)
                    for j, nodes in enumerate(found):
                        nodes = nodes[nodes >= 0]
                        one = q[i + j]
                        score = v[nodes] @ one / (norms[nodes] * np.linalg.norm(one))
                        lens = [len(node_ids[x]) for x in nodes]
                        cand = np.concatenate([node_ids[x] for x in nodes])
                        score = np.repeat(score, lens)
                        score, cand = score[cand != own[i + j]], cand[cand != own[i + j]]
                        top = np.lexsort((cand, -score))[:k]
                        for column, values in zip(cols, (np.full(len(top), own[i + j]), cand[top], score[top])):
                            column.append(values)
        return pa.table([pa.array(np.concatenate([np.empty(0, kind), *column])) for column, kind in zip(cols, ("<i8", "<i8", "<f8"))],
                        names=["query_id", "vec_id", "score"])
    found = (copies.groupBy(*keys).cogroup(sent.groupBy(*keys))
             .applyInArrow(run, "query_id long, vec_id long, score double").distinct())
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
