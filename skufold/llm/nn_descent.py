"""Embedding near-dedup: links at a cosine threshold found by NN-descent.

``near_links`` runs passes of ``descend``: every vector starts with the nearest of
the vectors beside it in a few random-hyperplane orders, and a round joins the
neighbours of each vector (in either direction) with each other, where one of the
two is new, until a round finds no new link. A list keeps ``k`` neighbours. A list
full of links is saturated: the next pass takes the saturated vectors alone, whose
lists are enlarged by their whole component, that is, hold k further vectors outside
it. When none is saturated, an audit compares vectors with all others by brute
force; a recall under ``recall`` starts a pass over all with new orders.
``near_duplicates`` then completes the links inside components by dense tiles, one
pair of blocks of a component at a time, which are counted, not listed.

Equal vectors are one vertex with a number of copies. Null or zero vectors and those
with null or non-finite components link with nothing; nor do vectors of different
lengths, or rows with a null id (component null, not kept). Rows that repeat are
copies; an id with several vectors has one row and links for each. An empty table
gives no rows. Other columns are not read.

A vector that very many lists hold is joined in chunks of ``CHUNK`` neighbours, dealt
anew every round. A component of n vectors costs (n / BLOCK)^2 tiles, none above
BLOCK rows a side. Every round is checkpointed. The audit's sample is ``AUDIT``
vectors, half of them from components; only that is sent to all tasks.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import connected_components
from ..operators.sizing import cpu_partitions
from .common import fresh, whole_groups, written

THRESHOLD, K, RECALL = 0.9, 8, 0.97
#: Orders a pass starts from, bits of an order's key, vectors beside each other that are compared.
ORDERS, BITS, LEAF = 6, 48, 32
CHUNK, BLOCK, AUDIT = 48, 512, 400
PASSES = 12


def vertices(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vid, id, copies, v): usable vectors, equal ones once, with their smallest id
    and a number of their own."""
    v = F.col(vec_col)
    # a null component makes forall null, hence unusable; abs(x) < inf fails for NaN too
    usable = (F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    return written(rows.filter(F.col(id_col).isNotNull() & usable).groupBy(v.alias("v"))
                   .agg(F.min(id_col).alias("id"), F.count(F.lit(1)).alias("copies"))
                   .select(F.monotonically_increasing_id().alias("vid"), "id", "copies", "v"))


def units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1, in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pairs(a: list, b: list, sim: list) -> pa.RecordBatch:
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return pa.RecordBatch.from_arrays([pa.array(join(a, np.int64)), pa.array(join(b, np.int64)),
                                       pa.array(join(sim, np.float64))], ["a", "b", "sim"])


def _first_lists(state: DataFrame, k: int, seed: int) -> DataFrame:
    """(a, b, sim): for each vector the k nearest of those beside it, by order."""
    kind = dict(state.dtypes)["v"]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column("v")
            dim = np.diff(vec.offsets.to_numpy())
            for d in np.unique(dim):
                part = batch.take(pa.array(np.flatnonzero(dim == d)))
                x = units(part.column("v"))
                for order in range(ORDERS):
                    planes = np.random.default_rng([seed, order, int(d)]).standard_normal((int(d), BITS))
                    key = (x @ planes > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key), int(d) * ORDERS + order, np.int64)), pa.array(key),
                         part.column("vid"), part.column("comp"), part.column("v")],
                        ["part", "key", "vid", "comp", "v"])

    # equal keys are told apart by a hash, so that a clump is cut like anything else
    keys = ["part", "key", "salt"]
    ordered = (state.mapInArrow(keyed, f"part long, key long, vid long, comp long, v {kind}")
               .withColumn("salt", F.xxhash64("vid", F.lit(seed)))
               .repartitionByRange(cpu_partitions(state.sparkSession), *keys).sortWithinPartitions(*keys)
               .select("part", "vid", "comp", "v"))

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaves of LEAF rows, each begun in the middle of the one before."""
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
            steps = max(0, (len(table) - LEAF) // (LEAF // 2) + 1)
            yield _leaf_pairs(table, [(i * (LEAF // 2), i * (LEAF // 2) + LEAF) for i in range(steps)], k)
            rest = table.slice(steps * (LEAF // 2))
        if rest is not None:
            yield _leaf_pairs(rest.combine_chunks(), [(0, len(rest))], k)
    return ordered.mapInArrow(beside, "a long, b long, sim double")


def _leaf_pairs(table: pa.Table, leaves: list[tuple[int, int]], k: int) -> pa.RecordBatch:
    a, b, sim = [], [], []
    vid, comp, part = (table[c].to_numpy() for c in ("vid", "comp", "part"))
    for first, last in leaves:
        cuts = [first, *(first + 1 + np.flatnonzero(part[first + 1:last] != part[first:last - 1])), last]
        for lo, hi in zip(cuts, cuts[1:]):  # one order of vectors of one length
            if hi - lo > 1:
                x = units(table["v"].slice(lo, hi - lo))
                s = x @ x.T
                s[comp[lo:hi, None] == comp[lo:hi]] = -2
                best = np.argsort(-s, axis=1)[:, :k]
                i, j = np.repeat(np.arange(hi - lo), best.shape[1]), best.ravel()
                ok = s[i, j] > -2
                a.append(vid[lo + i[ok]])
                b.append(vid[lo + j[ok]])
                sim.append(s[i, j][ok])
    return _pairs(a, b, sim)


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """found (a, b, sim, fresh) -> the k largest of each a, every b once; what was
    known before is not fresh."""
    once = found.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def descend(state: DataFrame, k: int = K, threshold: float = THRESHOLD, seed: int = 0) -> DataFrame:
    """state (vid, comp, v) -> lists (a, b, sim) of near vectors outside a's component."""
    spark = state.sparkSession
    kind, n = dict(state.dtypes)["v"], cpu_partitions(spark)
    lists = written(_nearest(_first_lists(state, k, seed).withColumn("fresh", F.lit(True)), k))
    turn = 0

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["x", "chunk"]):
            vid, comp, new, low = (table[c].to_numpy(zero_copy_only=False) for c in ("y", "comp", "fresh", "low"))
            vec = table["v"].combine_chunks()
            a, b, sim = [], [], []
            for lo, hi in zip(starts, starts[1:]):
                x = units(vec[lo:hi])
                s = x @ x.T
                c, f = comp[lo:hi], new[lo:hi]
                # only what enters the list of the row's vector
                i, j = np.nonzero((s > low[lo:hi, None]) & (c[:, None] != c) & (f[:, None] | f))
                a.append(vid[lo + i])
                b.append(vid[lo + j])
                sim.append(s[i, j])
            yield _pairs(a, b, sim)
    while True:
        turn += 1
        known = lists.filter(F.col("sim") >= threshold)
        before = known.count()
        lows = lists.groupBy("a").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).otherwise(F.lit(-2.0)).alias("low"))
        now = written(state.join(lows.withColumnRenamed("a", "vid"), "vid", "left")
                      .select(F.col("vid").alias("y"), "comp", "v", F.coalesce("low", F.lit(-2.0)).alias("low")))
        both = (lists.select(F.col("a").alias("x"), F.col("b").alias("y"), "fresh")
                .union(lists.select(F.col("b").alias("x"), F.col("a").alias("y"), "fresh"))
                .groupBy("x", "y").agg(F.max("fresh").alias("fresh")))
        sizes = (both.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.max("fresh").alias("any"))
                 .filter("any and n > 1").select("x", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
        dealt = (both.join(sizes, "x").join(now, "y")
                 .select("x", F.pmod(F.xxhash64("y", F.lit(turn)), F.col("chunks")).cast("int").alias("chunk"),
                         "y", "comp", "fresh", "low", "v")
                 .repartition(n, "x", "chunk").sortWithinPartitions("x", "chunk"))
        found = dealt.mapInArrow(joined, "a long, b long, sim double").withColumn("fresh", F.lit(True))
        lists = written(_nearest(lists.withColumn("fresh", F.lit(False)).union(found), k))
        if lists.filter(F.col("sim") >= threshold).count() <= before:
            return lists.select("a", "b", "sim")


def _tile_links(members: DataFrame, threshold: float) -> DataFrame:
    """members (vid, comp, copies, v) -> (vid, links): copies of the other vectors of
    its component at the threshold or above."""
    sizes = (members.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
             .select("comp", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    own, other = F.col("own"), F.col("other")
    tiles = (members.join(sizes, "comp").withColumn("own", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int"))
             .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
             .select("comp", F.least(own, other).alias("b1"), F.greatest(own, other).alias("b2"),
                     (own > other).alias("second"), "vid", "copies", "v"))
    keys = ["comp", "b1", "b2"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys):
            vid, copies, second, b1, b2 = (table[c].to_numpy(zero_copy_only=False)
                                           for c in ("vid", "copies", "second", "b1", "b2"))
            vec = table["v"].combine_chunks()
            links = np.zeros(len(vid), np.int64)
            for lo, hi in zip(starts, starts[1:]):
                x = units(vec[lo:hi])
                if b1[lo] == b2[lo]:
                    near = x @ x.T >= threshold
                    np.fill_diagonal(near, False)
                    links[lo:hi] = near @ copies[lo:hi]
                else:
                    p, q = np.flatnonzero(~second[lo:hi]), np.flatnonzero(second[lo:hi])
                    near = x[p] @ x[q].T >= threshold
                    links[lo + p] = near @ copies[lo + q]
                    links[lo + q] = near.T @ copies[lo + p]
            yield pa.RecordBatch.from_arrays([pa.array(vid), pa.array(links)], ["vid", "links"])
    dealt = tiles.repartition(cpu_partitions(members.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(count, "vid long, links long").groupBy("vid").agg(F.sum("links").alias("links"))


def _components(state: DataFrame, links: DataFrame) -> DataFrame:
    """state with comp: the smallest vid reachable by links (a, b) and components so far."""
    held = state.filter("comp != vid").select(F.col("vid").alias("a"), F.col("comp").alias("b"))
    comp = connected_components(links.select("a", "b").union(held), "a", "b")
    return written(state.drop("comp").join(comp.select(F.col("vertex").alias("vid"), "component"), "vid", "left")
                   .select("vid", F.coalesce("component", "vid").alias("comp"), "v"))


def audit(state: DataFrame, threshold: float, seed: int, size: int = AUDIT) -> tuple[int, int]:
    """(links of a sample of vectors by brute force, those of them inside components).

    Half of the sample is from components, half from all vectors, by hash."""
    first = lambda rows: rows.select("vid", "comp", "v").orderBy(F.xxhash64("vid", F.lit(seed))).limit(size // 2)
    linked = state.filter("comp != vid")
    sample = first(state).union(first(linked)).dropDuplicates(["vid"]).collect()  # size rows at most
    by_dim: dict[int, list] = {}
    for row in sample:
        by_dim.setdefault(len(row.v), []).append((row.vid, row.comp, list(row.v)))
    queries = {d: (np.array([r[0] for r in rows]), np.array([r[1] for r in rows]),
                   units(pa.array([r[2] for r in rows], pa.list_(pa.float64())))) for d, rows in by_dim.items()}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vid, comp = batch.column("vid").to_numpy(), batch.column("comp").to_numpy()
            dim = np.diff(batch.column("v").offsets.to_numpy())
            true = held = 0
            for d, (q, q_comp, x) in queries.items():
                at = np.flatnonzero(dim == d)
                if len(at):
                    near = units(batch.column("v").take(pa.array(at))) @ x.T >= threshold
                    near &= vid[at, None] != q
                    true += int(near.sum())
                    held += int((near & (comp[at, None] == q_comp)).sum())
            yield pa.RecordBatch.from_arrays([pa.array([true]), pa.array([held])], ["true", "held"])
    row = (state.mapInArrow(compare, "true long, held long")
           .agg(F.coalesce(F.sum("true"), F.lit(0)), F.coalesce(F.sum("held"), F.lit(0))).first())
    return row[0], row[1]


def near_links(vertex: DataFrame, threshold: float = THRESHOLD, k: int = K, recall: float = RECALL,
               passes: int = PASSES) -> DataFrame:
    """vertex (vid, v) -> (vid, comp, v), comp the smallest vid reachable by links."""
    state = written(vertex.select("vid", F.col("vid").alias("comp"), "v"))
    active, audits = state, 0
    for turn in range(passes):
        found = descend(active, k, threshold, seed=turn)
        links = written(found.filter(F.col("sim") >= threshold))
        state = _components(state, links)
        full = links.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
        active = written(state.join(full.select(F.col("a").alias("vid")), "vid", "left_semi"))
        if active.isEmpty():
            true, held = audit(state, threshold, audits)
            audits += 1
            if held >= recall * true:
                return state
            active = state
    true, held = audit(state, threshold, audits)
    if held < recall * true:
        warnings.warn(f"{held} of the {true} links of the audited vectors were found in {passes} passes")
    return state


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    threshold: float = THRESHOLD, k: int = K, recall: float = RECALL) -> DataFrame:
    """rows with n_links (other rows at the threshold or above), component_id (smallest
    id reachable by links, the row's own included) and kept (id = component_id)."""
    vertex = vertices(rows, id_col, vec_col)
    state = near_links(vertex.select("vid", "v"), threshold, k, recall)
    members = written(state.drop("v").join(vertex, "vid"))
    links = _tile_links(members.select("vid", "comp", "copies", "v"), threshold)
    least = members.groupBy("comp").agg(F.min("id").alias("least"))
    found = (members.join(least, "comp").join(links, "vid", "left")
             .select(F.col("v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "least"))
    v, out_links, least_ = fresh(rows, "_v", "_links", "_least")
    side = found.select(F.col("v").alias(v), F.col("links").alias(out_links), F.col("least").alias(least_))
    joined = rows.join(side, (F.col(vec_col) == F.col(v)) & F.col(id_col).isNotNull(), "left")
    return (joined.withColumn("n_links", F.coalesce(out_links, F.lit(0)).cast("long"))
            .withColumn("component_id", F.coalesce(least_, id_col))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
            .drop(v, out_links, least_))
