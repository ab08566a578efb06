"""Hierarchical density clusters from spanning trees (C5): merge tree, condensed tree,
stability selection with a distance threshold, labels. All steps are joins.

``merge_tree``: an edge of a spanning tree is the node at which two parts merge; its
parent is the next heavier edge that touches the merged part. Boruvka rounds over the
tree's edges give each round's components and their lightest outgoing edge. An edge
inside a component, lighter than that edge, lies on one chain with all such edges of
the component that no earlier round has placed: sorted, each is the next one's child
and the last the child of the outgoing edge. So log(n) rounds place every node
whatever the tree's depth, and sizes are prefix sums along chains, round by round.

A node of at least ``min_cluster_size`` points is big. Where both children are big a
cluster splits in two; otherwise the small child's points fall out. Pointers are
followed by doubling. The selection by stability goes from the clusters without
children up: in a task for a condensed tree of up to ``WHOLE_TREE`` clusters, which may
have hundreds of levels, and level by level over the tables for a larger one.

Equal vectors are one leaf with copies; such a leaf is a cluster of its own if it is
big, which ends where its copies are no neighbours any more, at its core distance
(never, if that is 0: density is infinite).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import saved
from .mst import contract, follow
from .pivots import numbered
from .sizing import cpu_partitions

INF = float("inf")
#: Clusters of a condensed tree that a task holds at once.
WHOLE_TREE = 1 << 20


def merge_tree(edges: DataFrame, leaves: DataFrame) -> DataFrame:
    """edges (w, lo, hi) of forests, leaves (vid, copies) -> (id, parent, size, w, up):
    nodes with their parent (null: a tree's top), points below, own weight (null for
    leaves) and the parent's weight. Edges are numbered in the order of (w, lo, hi);
    leaf v has id -1 - v."""
    e = numbered(edges, ["w", "lo", "hi"], "e").transform(saved)
    open_ = e.select("e", F.col("lo").alias("c1"), F.col("hi").alias("c2"))
    placed, above, turn = None, None, 0
    while True:
        # lightest edge that leaves each component
        out = (open_.filter("c1 != c2").select("e", F.explode(F.array("c1", "c2")).alias("c"))
               .groupBy("c").agg(F.min("e").alias("over")).transform(saved))
        if turn == 0:
            above = out
        else:
            inner = open_.filter("c1 = c2").join(out.withColumnRenamed("c", "c1"), "c1", "left")
            fits = F.col("over").isNull() | (F.col("e") < F.col("over"))
            here = inner.filter(fits).select("e", F.lit(turn).alias("turn"), F.col("c1").alias("chain"), "over").transform(saved)
            placed = here if placed is None else placed.union(here)
            open_ = open_.join(here, "e", "left_anti")
        if out.isEmpty():
            break
        tips = out.join(open_.select(F.col("e").alias("over"), "c1", "c2"), "over")
        merged = contract(tips.select("c", F.when(F.col("c1") == F.col("c"), F.col("c2")).otherwise(F.col("c1")).alias("to")))
        name = lambda c: merged.select(F.col("c").alias(c), F.col("root").alias("r" + c))
        open_ = (open_.join(name("c1"), "c1", "left").join(name("c2"), "c2", "left")
                 .select("e", F.coalesce("rc1", "c1").alias("c1"), F.coalesce("rc2", "c2").alias("c2"))).transform(saved)
        turn += 1
    leaf = leaves.select((-1 - F.col("vid")).alias("id"), "vid", F.col("copies").alias("size"))
    if placed is None:
        return leaf.select("id", F.lit(None).cast("long").alias("parent"), "size",
                           F.lit(None).cast("double").alias("w"), F.lit(None).cast("double").alias("up"))
    nodes = numbered(placed, ["turn", "chain", "e"], "i").transform(saved)
    after = nodes.select((F.col("i") - 1).alias("i"), "turn", "chain", F.col("e").alias("next"))
    nodes = (nodes.join(after, ["i", "turn", "chain"], "left")
             .select("e", "turn", "chain", "i", F.coalesce("next", "over").alias("parent"),
                     F.col("next").isNull().alias("top"))).transform(saved)
    leaf = leaf.join(above.select(F.col("c").alias("vid"), F.col("over").alias("parent")), "vid", "left").drop("vid").transform(saved)
    # sizes: chains hang from chains of later rounds only
    parts = F.spark_partition_id()
    given = leaf.filter(F.col("parent").isNotNull()).select("parent", "size")
    sized = None
    for t in range(1, turn + 1):
        own = given.groupBy(F.col("parent").alias("e")).agg(F.sum("size").alias("own"))
        chain = (nodes.filter(F.col("turn") == t).join(own, "e", "left")
                 .repartitionByRange("chain", "i").withColumn("p", parts).transform(saved))
        sums = chain.groupBy("chain", "p").agg(F.sum("own").alias("s"))
        before = Window.partitionBy("chain").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select("chain", "p", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("o"))
        along = Window.partitionBy("chain", "p").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
        here = (chain.withColumn("s", F.coalesce(F.sum("own").over(along), F.lit(0))).join(offsets, ["chain", "p"])
                .select("e", "parent", "top", (F.col("s") + F.col("o")).alias("size"))).transform(saved)
        sized = here if sized is None else sized.union(here)
        given = given.union(here.filter("top and parent is not null").select("parent", "size"))
    w = e.select("e", "w")
    up = w.select(F.col("e").alias("parent"), F.col("w").alias("up"))
    inner = sized.join(w, "e").select(F.col("e").alias("id"), "parent", "size", "w")
    return (inner.union(leaf.select("id", "parent", "size", F.lit(None).cast("double").alias("w")))
            .join(up, "parent", "left").select("id", "parent", "size", "w", "up").transform(saved))


def _lambda(w):
    return F.when(w > 0, 1.0 / w).otherwise(F.lit(INF))


def condensed(tree: DataFrame, cores: DataFrame, min_cluster_size: int) -> tuple[DataFrame, DataFrame]:
    """(clusters, members): clusters (c, parent, birth, size, stability), birth the
    density 1 / w at which it splits off (0 for a tree's top, whose parent is null);
    members (vid, c), the cluster that a leaf falls out of (null: none)."""
    big = F.col("size") >= min_cluster_size
    halves = tree.filter(big & F.col("parent").isNotNull()).groupBy("parent").agg(
        (F.count(F.lit(1)) == 2).alias("split"))
    marked = (tree.join(halves, "parent", "left")
              .withColumn("head", big & (F.col("parent").isNull() | F.coalesce("split", F.lit(False))))).transform(saved)
    ends = follow(marked.select(F.col("id").alias("x"), F.when(~F.col("head"), F.col("parent")).alias("to")))
    heads = marked.filter("head").select(F.col("id").alias("end"), F.lit(True).alias("ok"))
    label = (ends.join(heads, "end", "left").select(F.col("x").alias("id"), F.when(F.col("ok"), F.col("end")).alias("c")))
    named = marked.join(label, "id").transform(saved)
    over = named.select(F.col("id").alias("parent"), F.col("c").alias("pc"), F.col("size").alias("ps"))
    joined = named.join(over, "parent", "left").transform(saved)
    clusters = joined.filter("head").select(
        F.col("id").alias("c"), F.col("pc").alias("parent"),
        F.when(F.col("parent").isNull(), F.lit(0.0)).otherwise(_lambda(F.col("up"))).alias("birth"), "size")
    leaves = named.filter("id < 0").select("id", (-1 - F.col("id")).alias("vid"), "size", "c")
    dying = (leaves.filter(big).join(cores, "vid").select("c", "size", _lambda(F.col("core")).alias("at")))
    # what leaves a cluster: small children of its nodes, and the two it splits into
    gone = joined.filter(F.col("pc").isNotNull() & (F.col("ps") >= min_cluster_size) & (F.col("head") | ~big)).select(
        F.col("pc").alias("c"), "size", _lambda(F.col("up")).alias("at"))
    weight = F.when(F.col("at") <= F.col("birth"), F.lit(0.0)).otherwise(F.col("size") * (F.col("at") - F.col("birth")))
    stability = (gone.union(dying).join(clusters.select("c", "birth"), "c").groupBy("c").agg(F.sum(weight).alias("stability")))
    return (clusters.join(stability, "c", "left").withColumn("stability", F.coalesce("stability", F.lit(0.0))).transform(saved),
            leaves.select("vid", "c"))


def _best_of_tree(tree: pa.Table) -> pa.Table:
    """(c, best) of all clusters of a tree but its top. A cluster's number is above those of
    the clusters that split off from it."""
    order = np.argsort(tree["c"].to_numpy())
    c, parent, total = (tree[x].to_numpy()[order] for x in ("c", "parent", "stability"))
    up, inside = np.searchsorted(c, parent), np.isin(parent, c)
    up, inside, total = up.tolist(), inside.tolist(), total.tolist()
    sums, best = [None] * len(c), [True] * len(c)
    for i in range(len(c)):
        if sums[i] is not None:
            best[i] = total[i] >= sums[i]
            total[i] = max(total[i], sums[i])
        if inside[i]:
            at = up[i]
            sums[at] = total[i] if sums[at] is None else sums[at] + total[i]
    return pa.table([pa.array(c), pa.array(best, pa.bool_())], names=["c", "best"])


def _best_by_level(inner: DataFrame) -> DataFrame:
    """(c, best) of clusters (c, parent, stability) of any number, level by level."""
    if inner.isEmpty():
        return inner.select("c", F.lit(True).alias("best"))
    below = inner.select(F.col("parent").alias("c")).distinct()
    open_ = inner.join(below, "c", "left_semi").select("c", "parent", "stability").transform(saved)
    total = inner.join(below, "c", "left_anti").select(
        "c", "parent", F.col("stability").alias("total"), F.lit(True).alias("best")).transform(saved)
    done = total
    while not open_.isEmpty():
        sums = total.groupBy(F.col("parent").alias("c")).agg(F.sum("total").alias("sum"), F.count(F.lit(1)).alias("n"))
        ready = open_.join(sums.filter("n = 2"), "c").select(
            "c", "parent", F.greatest("stability", "sum").alias("total"), (F.col("stability") >= F.col("sum")).alias("best"))
        ready = ready.transform(saved)
        open_ = open_.join(ready, "c", "left_anti").transform(saved)
        # only clusters whose parent is still open count on
        total = total.union(ready).join(open_.select(F.col("c").alias("parent")), "parent", "left_semi").select(
            "c", "parent", "total", "best").transform(saved)
        done = done.union(ready)
    return done.select("c", "best")


def select_clusters(clusters: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """clusters -> (c, chosen): the selected cluster that c is or lies in, null if none.

    Excess of mass: a cluster stays if its stability is at least that of the best
    selection below it; a tree's top is never selected. Selected clusters that split
    off below ``epsilon`` give way to the first one above them that did not, or to the
    child of the top."""
    inner = clusters.filter(F.col("parent").isNotNull())
    tops = follow(clusters.select(F.col("c").alias("x"), F.col("parent").alias("to")))
    whole = tops.groupBy("end").agg((F.count(F.lit(1)) <= WHOLE_TREE).alias("whole"))
    named = inner.join(tops.withColumnRenamed("x", "c"), "c").join(whole, "end").select(
        "c", "parent", "stability", "end", "whole").transform(saved)
    small = (named.filter("whole").repartition(cpu_partitions(clusters.sparkSession), "end")
             .groupBy("end").applyInArrow(_best_of_tree, "c long, best boolean"))
    best = small.union(_best_by_level(named.filter("not whole").select("c", "parent", "stability"))).transform(saved)
    # the topmost best cluster on the way up, by doubling
    way = inner.join(best, "c").select(F.col("c").alias("x"), F.col("parent").alias("to"),
                                       F.when(F.col("best"), F.col("c")).alias("top")).transform(saved)
    while True:
        step = way.select(F.col("x").alias("to"), F.col("to").alias("next"), F.col("top").alias("upper"))
        after = way.join(step, "to", "left").select(
            "x", F.col("next").alias("to"), F.coalesce("upper", "top").alias("top")).transform(saved)
        way = after
        if way.filter("to is not null").isEmpty():
            break
    chosen = way.filter("top is not null").select(F.col("top").alias("x")).distinct()
    if epsilon > 0:
        tops = clusters.filter(F.col("parent").isNull()).select(F.col("c").alias("parent"), F.lit(True).alias("first"))
        wide = F.when(F.col("birth") > 0, 1.0 / F.col("birth")).otherwise(F.lit(INF))
        climb = inner.join(tops, "parent", "left").select(
            F.col("c").alias("x"), (wide < epsilon).alias("tight"),
            F.when(F.col("first").isNull() & (wide <= epsilon), F.col("parent")).alias("to"))
        ends = follow(climb.select("x", "to"))
        chosen = (chosen.join(climb.select("x", "tight"), "x").join(ends, "x")
                  .select(F.when(F.col("tight"), F.col("end")).otherwise(F.col("x")).alias("x")).distinct()).transform(saved)
    flag = clusters.select(F.col("c").alias("x"), "parent").join(chosen.withColumn("is", F.lit(True)), "x", "left")
    ends = follow(flag.select("x", F.when(F.col("is").isNull(), F.col("parent")).alias("to")))
    return (ends.join(chosen.select(F.col("x").alias("end"), F.lit(True).alias("is")), "end", "left")
            .select(F.col("x").alias("c"), F.when(F.col("is"), F.col("end")).alias("chosen")))
