"""Minimum spanning trees of mutual reachability, per brand, without all pairs.

Boruvka rounds: every component takes its lightest edge to an outside point, ties by
the points' numbers. Before vectors are compared, a component has an upper bound:
the lightest edge that leaves it among those known (each point's best so far, and a
path through all points in the blocks' order, which no component can lie on whole).
Only points that may have a lighter edge search, only blocks whose boxes are within
that bound, and never a pair of blocks inside one component. A point's best outside
edge stays its best until the two components are one, and bounds it from below
afterwards. Rounds are logarithmic in the points; each is saved in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import saved
from .pivots import PointIndex, exact, meet, near_blocks, numbered, rough

EDGE = ["w", "lo", "hi"]


def follow(pointers: DataFrame) -> DataFrame:
    """(x, to), to null at an end and no cycles -> (x, end), by doubling the pointers."""
    now = pointers.select("x", F.coalesce("to", "x").alias("end")).transform(saved)
    while True:
        for _ in range(2):
            step = now.select(F.col("x").alias("end"), F.col("end").alias("next"))
            jumped = now.join(step, "end", "left").select("x", F.coalesce("next", "end").alias("next"),
                                                          F.col("end").alias("was"))
            now = jumped.select("x", F.col("next").alias("end"), (F.col("next") != F.col("was")).alias("moved"))
        after = now.transform(saved)
        now = after.select("x", "end")
        if after.filter("moved").isEmpty():
            return now


def contract(step: DataFrame) -> DataFrame:
    """(c, to): every component's lightest edge leads to another -> (c, root). Such
    pointers only cycle between two, of which the smaller is the root."""
    back = step.select(F.col("c").alias("to"), F.col("to").alias("back"))
    ends = step.join(back, "to").select(F.col("c").alias("x"), F.when(
        (F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.lit(None)).otherwise(F.col("to")).alias("to"))
    return follow(ends).select(F.col("x").alias("c"), F.col("end").alias("root"))


def _lightest(i: np.ndarray, w: np.ndarray, p: np.ndarray, q: np.ndarray):
    """First of each i by (w, smaller number, larger number)."""
    lo, hi = np.minimum(p, q), np.maximum(p, q)
    order = np.lexsort((hi, lo, w, i))
    i, first = np.unique(i[order], return_index=True)
    at = order[first]
    return i, w[at], lo[at], hi[at]


def _search(met, metric: str):
    """Lightest edge of each point that looks (reach >= 0) to points of other components,
    over all blocks that its block meets; what it has found bounds how far it still looks."""
    best = {}
    for a, b, _ in met:
        if id(a) not in best:
            best[id(a)] = a, a["reach"].copy(), []
        _, reach, edges = best[id(a)]
        rows = np.flatnonzero(reach >= 0)
        if not len(rows):
            continue
        d, off = rough(a["x"][rows], b["x"], metric)
        mr = np.maximum(np.maximum(d, a["core"][rows, None]), b["core"])
        mr[a["comp"][rows, None] == b["comp"]] = np.inf
        least = mr.min(axis=1)
        i, j = np.nonzero((mr <= np.minimum(least + 2 * off, reach[rows] + off)[:, None]) & (mr < np.inf))
        w = np.maximum(np.maximum(exact(a["x"][rows[i]], b["x"][j], metric), a["core"][rows[i]]), b["core"][j])
        i, w, lo, hi = _lightest(rows[i], w, a["vids"][rows[i]], b["vids"][j])
        reach[i] = np.minimum(reach[i], w)
        edges.append((i, w, lo, hi))
    found = []
    for a, _, edges in best.values():
        if edges:
            i, w, lo, hi = _lightest(*(np.concatenate(x) for x in zip(*edges)))
            found.append((a["vids"][i], w, lo, hi))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else None


FOUND = "vid long, w double, lo long, hi long"


def _states(points: DataFrame, *columns: str) -> DataFrame:
    """(block, s): the points' columns in the blocks' order."""
    inner = F.transform(F.array_sort(F.collect_list(F.struct("pos", *columns))),
                        lambda x: F.struct(*[x[c].alias(c) for c in columns]))
    return points.groupBy("block").agg(inner.alias("s"))


def _path(index: PointIndex, state: DataFrame) -> DataFrame:
    """(w, lo, hi): a path through all points of each brand: along blocks, and from the
    last of a block to the first of the brand's next."""
    order = numbered(index.blocks.select("g", "block"), ["g", "block"], "i")
    after = order.select("g", (F.col("i") - 1).alias("i"), F.col("block").alias("other"))
    own = index.blocks.select("block", F.col("block").alias("other"))

    def steps(a: dict, b: dict, same: bool, metric: str):
        n = len(a["vids"])
        i = np.arange(n - 1) if same else np.array([n - 1])
        j = i + 1 if same else np.array([0])
        w = np.maximum(np.maximum(exact(a["x"][i], b["x"][j], metric), a["core"][i]), b["core"][j])
        p, q = a["vids"][i], b["vids"][j]
        return w, np.minimum(p, q), np.maximum(p, q)
    pairs = own.union(order.join(after, ["g", "i"]).select("block", "other"))
    return meet(index, pairs, steps, "w double, lo long, hi long", state)


def _edge() -> Column:
    return F.struct(*[F.col(c) for c in EDGE])


def _found(index: PointIndex, look: DataFrame) -> DataFrame:
    """(vid, f): lightest edge (w, lo, hi) that leaves the component, for each point that
    looks (reach >= 0) and has one within its reach."""
    blocks = look.groupBy("block").agg(F.max("reach").alias("r"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    blocks = blocks.transform(saved)
    uniform = blocks.select(F.col("block").alias("other"), F.col("c0").alias("d0"), F.col("c1").alias("d1"))
    pairs = (near_blocks(index, blocks.filter("r >= 0").select("block", "r")).join(blocks.drop("r"), "block")
             .join(uniform, "other").filter("not (c0 = c1 and d0 = d1 and c0 = d0)").select("block", "other"))
    return (meet(index, pairs, _search, FOUND, _states(look, "core", "comp", "reach"), whole=True)
            .groupBy("vid").agg(F.min(_edge()).alias("f")))


def spanning_trees(index: PointIndex, cores: DataFrame) -> DataFrame:
    """cores (vid, core) -> (w, lo, hi), the edges of each brand's minimum spanning tree
    under max(core, core, distance); points without a core have no edges."""
    points = (index.points.select("vid", "block", "pos").join(cores, "vid", "left")
              .withColumn("core", F.coalesce("core", F.lit(float("inf")))))
    state = points.withColumns({"comp": F.col("vid"), "reach": F.lit(float("inf"))})
    first = _states(state.transform(saved), "core", "comp", "reach")
    own = index.blocks.select("block", F.col("block").alias("other"))
    path = _path(index, first).filter(F.col("w") < float("inf")).transform(saved)
    near = meet(index, own, _search, FOUND, first, whole=True).filter(F.col("w") < float("inf"))
    # known: no edge outside the component is lighter than w
    now = (points.withColumn("comp", F.col("vid")).join(near, "vid", "left")
           .withColumn("known", F.lit(False)).transform(saved))
    trees, turn = None, -1
    while True:
        turn += 1
        comp = now.select(F.col("vid").alias("o"), F.col("comp").alias("oc"))
        other = F.when(F.col("lo") == F.col("vid"), F.col("hi")).otherwise(F.col("lo"))
        here = (now.withColumn("o", other).join(comp, "o", "left")
                .withColumn("out", F.coalesce(F.col("oc") != F.col("comp"), F.lit(False))).drop("o", "oc")).transform(saved)
        ends = (path.join(comp.select(F.col("o").alias("lo"), F.col("oc").alias("c1")), "lo")
                .join(comp.select(F.col("o").alias("hi"), F.col("oc").alias("c2")), "hi").filter("c1 != c2"))
        path = ends.select(*EDGE).transform(saved)  # a path edge inside a component is of no more use
        sides = F.explode(F.array("c1", "c2")).alias("comp")
        bound = (here.filter("out").select("comp", _edge().alias("e"))
                 .union(ends.select(sides, _edge().alias("e"))).groupBy("comp").agg(F.min("e").alias("bound")))
        look = here.join(bound, "comp", "left")
        least = F.greatest(F.col("core"), F.when(F.col("known"), F.coalesce("w", F.lit(0.0))).otherwise(F.lit(0.0)))
        asks = F.col("bound").isNotNull() & ~(F.col("known") & F.col("out")) & (least <= F.col("bound.w"))
        reach = F.when(asks, F.col("bound.w")).otherwise(F.lit(-1.0)).alias("reach")
        look = look.select("*", reach).transform(saved)
        if turn > 1:  # one point of each component looks first: the others need look no further than it
            scout = look.filter("reach >= 0").groupBy("comp").agg(F.min("vid").alias("scout"))
            first = look.join(scout, "comp", "left").withColumn("reach", F.when(
                F.col("vid") == F.col("scout"), F.col("reach")).otherwise(F.lit(-1.0))).drop("scout").transform(saved)
            seen = _found(index, first).join(first.select("vid", "comp"), "vid").select("comp", F.col("f").alias("e"))
            bound = bound.select("comp", F.col("bound").alias("e")).union(seen).groupBy("comp").agg(F.min("e").alias("bound"))
            look = look.drop("bound", "reach").join(bound, "comp", "left").select("*", reach).transform(saved)
        found = _found(index, look)
        # a point that has searched knows: its lightest edge, or none up to the bound
        asked = F.col("reach") >= 0
        better = F.when(asked & F.col("f").isNotNull(), F.col("f"))
        pick = lambda c: F.when(asked, better[c]).otherwise(F.col(c)).alias(c)
        done = (look.join(found, "vid", "left")
                .select("vid", "block", "pos", "core", "comp",
                        F.when(asked, F.coalesce(better["w"], F.col("bound.w"))).otherwise(F.col("w")).alias("w"),
                        pick("lo"), pick("hi"), (F.col("known") | asked).alias("known"),
                        (F.when(asked, F.col("f").isNotNull()).otherwise(F.col("out"))).alias("out"), "bound")).transform(saved)
        chosen = (done.filter("out").select("comp", _edge().alias("e"))
                  .union(done.filter("bound is not null").select("comp", F.col("bound").alias("e")))
                  .groupBy("comp").agg(F.min("e").alias("e")).select("comp", "e.*").transform(saved))
        if chosen.isEmpty():
            return trees if trees is not None else now.select(*EDGE).limit(0)
        edges = chosen.select(*EDGE).distinct()
        trees = edges if trees is None else trees.union(edges)
        tips = (chosen.join(comp.select(F.col("o").alias("lo"), F.col("oc").alias("c1")), "lo")
                .join(comp.select(F.col("o").alias("hi"), F.col("oc").alias("c2")), "hi"))
        merged = contract(tips.select(F.col("comp").alias("c"), F.when(F.col("c1") == F.col("comp"), F.col("c2"))
                                      .otherwise(F.col("c1")).alias("to")))
        now = (done.drop("bound", "out").join(merged.withColumnRenamed("c", "comp"), "comp", "left")
               .withColumn("comp", F.coalesce("root", "comp")).drop("root").transform(saved))
