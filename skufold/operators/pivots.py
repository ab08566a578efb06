"""Blocks of near points per brand, with distance boxes that tell blocks apart.

``build`` gives every brand a few pivots (points with the smallest hashes, more for
larger brands) and every point its distances to them. Points of one nearest pivot, in
the order of the next two, are cut into blocks of at most BLOCK; a block knows the least
and largest distance of its points to each pivot (its box). By the triangle
inequality no point of one block is nearer to one of another than the largest gap
between their boxes (``gap``). ``near_blocks`` joins boxes, no vectors, first of
groups of SUPER blocks, then of the blocks of near groups; only pairs of blocks
that survive fetch their vectors and are compared densely in a task (``meet``).

Everything found is exact; a box only ever rules out. Points of a hot brand are
dealt over salts when they meet the pivots and over blocks afterwards. Vectors of a
brand have one length; rows without a vector have no place in the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import saved
from .batches import whole_groups
from .sizing import cpu_partitions

BLOCK, SUPER = 128, 32
#: Blocks on a side of a tile, in these limits so many that every core has some; a
#: task holds twice that.
LEAST_TILE, MOST_TILE = 16, 128
#: Rows that a tile returns at once.
ROWS_AT_ONCE = 1 << 15
#: Pivots per brand: about the root of its points, in these limits.
LEAST_PIVOTS, MOST_PIVOTS = 4, 48
ROWS_PER_SALT = 8192
#: Relative slack for rounding, in distances and in squared ones.
SLACK, SLACK_SQ = 1e-9, 1e-11


@dataclass(frozen=True)
class PointIndex:
    """blocks: (g, block, super, vids, keys, copies, v, lo, hi), v the vectors one after
    the other; points: (g, vid, key, copies, block, pos); vids number the points in
    the order of (g, key); tiles: (block, tile), runs of a brand's blocks."""
    blocks: DataFrame
    points: DataFrame
    tiles: DataFrame
    metric: str


def numbered(df: DataFrame, order: list[str], name: str = "vid") -> DataFrame:
    """df, written, with a number that follows ``order``, from range partitions and
    their sizes."""
    t = (df.repartitionByRange(*order).sortWithinPartitions(*order)
         .withColumn("_i", F.monotonically_increasing_id()).transform(saved))
    part = F.shiftright("_i", 33)
    sizes = t.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = sizes.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    return (t.withColumn("_p", part).join(F.broadcast(offsets), "_p")
            .withColumn(name, F.col("_o") + F.col("_i").bitwiseAND((1 << 33) - 1)).drop("_p", "_i", "_o"))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    """Vectors of one length, nested or one after the other, as rows."""
    flat = column
    while pa.types.is_list(flat.type) or pa.types.is_large_list(flat.type):
        flat = flat.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(rows, -1)


def exact(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of equally many rows, the same whatever else is in a task."""
    out = np.empty(len(x))
    for i in range(0, len(x), 1 << 16):
        d = x[i:i + (1 << 16)] - y[i:i + (1 << 16)]
        out[i:i + (1 << 16)] = np.abs(d).sum(axis=1) if metric == "manhattan" else np.sqrt((d * d).sum(axis=1))
    return out


def rough(x: np.ndarray, y: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """All distances, and how far they may lie from the exact ones."""
    if metric == "manhattan":
        out = np.zeros((len(x), len(y)))
        for p, q in zip(x.T, y.T):
            out += np.abs(p[:, None] - q)
        return out, SLACK * max(float(out.max(initial=0)), 1e-300)
    a, b = (x * x).sum(axis=1), (y * y).sum(axis=1)
    scale = float(a.max(initial=0) + b.max(initial=0))
    sq = a[:, None] + b - 2 * (x @ y.T)
    return np.sqrt(np.maximum(sq, 0)), float(np.sqrt(SLACK_SQ * scale))


def build(points: DataFrame, group: str, key: str, vec: str, metric: str = "euclidean",
          copies: str | None = None) -> PointIndex:
    spark = points.sparkSession
    n = cpu_partitions(spark)
    number = "float" if dict(points.dtypes)[vec] == "array<float>" else "double"  # tasks compute with doubles
    rows = numbered(points.filter(F.col(vec).isNotNull()).select(
        F.col(group).alias("g"), F.col(key).alias("key"), F.col(vec).cast(f"array<{number}>").alias("v"),
        (F.col(copies) if copies else F.lit(1)).cast("long").alias("copies")), ["g", "key"])
    kinds = dict(rows.dtypes)
    size = F.col("n")
    brands = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).select(
        "g", F.ceil(size / ROWS_PER_SALT).cast("int").alias("salts"),
        F.least(size, F.greatest(F.lit(LEAST_PIVOTS), F.least(F.lit(MOST_PIVOTS), F.ceil(F.sqrt(size) / 2))))
        .cast("int").alias("m"))
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("key"), "vid"))
    first = rows.select("g", "key", "vid").withColumn("r", rank).filter(F.col("r") <= MOST_PIVOTS)
    pivots = (first.join(brands, "g").filter(F.col("r") <= F.col("m")).select("vid", "r", "salts")
              .join(rows.select("vid", "g", "v"), "vid")
              .select("g", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "r",
                      F.col("v").alias("pv")))
    salted = rows.join(brands.select("g", "salts"), "g").withColumn(
        "salt", F.pmod(F.xxhash64("vid"), F.col("salts")).cast("int")).drop("salts")
    schema = (f"g {kinds['g']}, vid long, key {kinds['key']}, copies long, v array<{number}>, "
              "p1 int, p2 int, p3 int, d array<double>")

    def distances(left: pa.Table, right: pa.Table) -> pa.Table:
        x = matrix(left["v"].combine_chunks(), len(left))
        right = right.sort_by("r")
        p = matrix(right["pv"].combine_chunks(), len(right))
        i, j = np.repeat(np.arange(len(x)), len(p)), np.tile(np.arange(len(p)), len(x))
        d = exact(x[i], p[j], metric).reshape(len(x), len(p))
        near = np.argsort(d, axis=1, kind="stable")
        near = np.concatenate((near, np.full((len(x), 3), -1)), axis=1)[:, :3].astype(np.int32)
        ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(p))
        return pa.table([left["g"], left["vid"], left["key"], left["copies"], left["v"], *map(pa.array, near.T),
                         pa.ListArray.from_arrays(ends, pa.array(d.ravel()))],
                        names=["g", "vid", "key", "copies", "v", "p1", "p2", "p3", "d"])
    placed = (salted.groupBy("g", "salt").cogroup(pivots.groupBy("g", "salt")).applyInArrow(distances, schema))
    order = ["g", "p1", "p2", "p3", "vid"]
    dealt = placed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    out = (f"g {kinds['g']}, block long, super long, vids array<long>, keys array<{kinds['key']}>, "
           f"copies array<long>, v array<{number}>, lo array<double>, hi array<double>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, count = TaskContext.get().partitionId() << 33, 0
        last = None
        for table, starts in whole_groups(_pieces(batches), ["g", "p1", "piece"]):
            for lo, hi in zip(starts, starts[1:]):
                t = table.slice(lo, hi - lo).combine_chunks()
                if last is not None and t["g"][0].as_py() != last:
                    count += -count % SUPER  # a super holds one brand
                last = t["g"][0].as_py()
                d = matrix(t["d"].combine_chunks(), len(t))
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                v = t["v"].combine_chunks().flatten()
                yield pa.RecordBatch.from_arrays(
                    [t["g"].combine_chunks()[:1], pa.array([part + count]), pa.array([part + count // SUPER * SUPER]),
                     *(one(t[c].combine_chunks()) for c in ("vid", "key", "copies")), one(v),
                     one(pa.array(d.min(axis=0))), one(pa.array(d.max(axis=0)))],
                    ["g", "block", "super", "vids", "keys", "copies", "v", "lo", "hi"])
                count += 1
    blocks = dealt.mapInArrow(cut, out).transform(saved)
    inside = F.posexplode(F.arrays_zip("vids", "keys", "copies"))
    points_ = (blocks.select("g", "block", inside.alias("pos", "x"))
               .select("g", F.col("x.vids").alias("vid"), F.col("x.keys").alias("key"),
                       F.col("x.copies").alias("copies"), "block", "pos"))
    runs = numbered(blocks.select("g", "block"), ["g", "block"], "i")
    side = min(MOST_TILE, max(LEAST_TILE, runs.count() // spark.sparkContext.defaultParallelism))
    tiles = runs.select("block", F.floor(F.col("i") / side).alias("tile")).transform(saved)
    return PointIndex(blocks, points_, tiles, metric)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, with the number of the block inside their run of brand and pivot."""
    last, seen = None, 0
    for batch in batches:
        g, p1 = batch.column("g"), batch.column("p1")
        change = [pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in (g, p1)]
        cuts = [0, *(np.flatnonzero(change[0] | change[1]) + 1).tolist()] if batch.num_rows else []
        piece = np.empty(batch.num_rows, np.int64)
        for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows]):
            name = (g[lo].as_py(), p1[lo].as_py())
            if name != last:
                last, seen = name, 0
            piece[lo:hi] = (seen + np.arange(hi - lo)) // BLOCK
            seen += hi - lo
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(piece)], [*batch.schema.names, "piece"])


def gap(lo_a: str, hi_a: str, lo_b: str, hi_b: str) -> Column:
    """Least distance of points in two boxes."""
    sides = F.zip_with(F.zip_with(lo_b, hi_a, lambda x, y: x - y), F.zip_with(lo_a, hi_b, lambda x, y: x - y),
                       lambda x, y: F.greatest(x, y))
    return F.array_max(sides)


def near_blocks(index: PointIndex, radius: DataFrame) -> DataFrame:
    """radius (block, r): how far points of a block look -> (block, other) with boxes at
    most so far apart, block itself included. Boxes of supers are joined first."""
    boxes = index.blocks.select("g", "block", "super", "lo", "hi")
    look = boxes.join(radius, "block")
    wide = (boxes.select("g", "super", F.posexplode(F.arrays_zip("lo", "hi")).alias("i", "x"))
            .groupBy("g", "super", "i").agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"))
            .groupBy("g", "super").agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("x"))
            .select("g", "super", F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi")))
    reach = look.groupBy("super").agg(F.max("r").alias("r"))
    side = lambda df, *names: df.select("g", *[F.col(c).alias(c + "_b") for c in names])
    within = gap("lo", "hi", "lo_b", "hi_b") * (1 - SLACK) <= F.col("r") * (1 + SLACK)
    supers = (wide.join(reach, "super").join(side(wide, "super", "lo", "hi"), "g").filter(within)
              .select("super", "super_b"))
    near = (look.drop("g").join(supers, "super")
            .join(side(boxes, "block", "super", "lo", "hi"), "super_b").filter(within))
    return near.select("block", F.col("block_b").alias("other"))


def meet(index: PointIndex, pairs: DataFrame, fn, schema: str, state: DataFrame | None = None,
         named: bool = False, whole: bool = False) -> DataFrame:
    """fn(row of block, row of other, same, metric) -> columns, for each pair (block, other).

    A row is a dict of arrays of a block: keys, vids, copies, x (vectors), and what
    ``state`` (block, s: array of structs in the blocks' order) holds for its points.
    ``named``: the brand comes first. ``whole``: fn(iterator of (row, row, same), metric) ->
    columns, for all pairs of a tile at once.
    """
    metric = index.metric
    body = index.blocks.select("block", "g", "vids", "keys", "copies", "v")
    names = ["vids", "keys", "copies", "v"]
    if state is not None:
        body = body.join(state, "block")
        names.append("s")
    at = lambda block, tile: index.tiles.select(F.col("block").alias(block), F.col("tile").alias(tile))
    ends = pairs.join(at("block", "ta"), "block").join(at("other", "tb"), "other")
    sent = F.explode(F.array(F.struct(F.col("block"), F.array("other").alias("others")),
                             F.struct(F.col("other").alias("block"), F.array().cast("array<bigint>").alias("others"))))
    members = (ends.select("ta", "tb", sent.alias("x")).groupBy("ta", "tb", F.col("x.block").alias("block"))
               .agg(F.flatten(F.collect_list("x.others")).alias("others")))
    rows = members.join(body, "block").repartition(cpu_partitions(body.sparkSession), "ta", "tb")
    out_names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def side(batch: pa.RecordBatch, k: int) -> dict:
        cell = {c: batch.column(c)[k].values for c in names}
        row = {"vids": cell["vids"].to_numpy(), "keys": cell["keys"], "copies": cell["copies"].to_numpy()}
        row["x"] = matrix(cell["v"], len(row["vids"]))
        if "s" in cell:
            s = cell["s"]
            row |= {s.type.field(i).name: s.field(i).to_numpy(zero_copy_only=False) for i in range(s.type.num_fields)}
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, todo = {}, []
        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.column("block")[k].as_py()
                sides[block] = side(batch, k), batch.column("g")[k]
                todo += [(block, other) for other in batch.column("others")[k].as_py()]
        met = ((sides[a][0], sides[b][0], a == b) for a, b in todo)
        found = [fn(met, metric)] if whole else (fn(*x, metric) for x in met)
        ready, many = [], 0
        for (block, _), columns in zip(todo, found):
            if columns is None or not len(columns[0]):
                continue
            columns = [pa.array(c) if isinstance(c, np.ndarray) else c for c in columns]
            if named:
                columns.insert(0, pa.repeat(sides[block][1], len(columns[0])))
            ready.append(pa.RecordBatch.from_arrays(columns, out_names))
            many += ready[-1].num_rows
            if many >= ROWS_AT_ONCE:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                ready, many = [], 0
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
    return rows.groupBy("ta", "tb").applyInArrow(_typed(run), schema)


def _typed(run):
    """The hints by which Spark knows a function of batches (postponed ones name no types)."""
    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def _within(index: PointIndex, eps: float) -> DataFrame:
    reach = index.blocks.select("block", F.lit(float(eps)).alias("r"))
    return near_blocks(index, reach).filter("block <= other")


def core_states(index: PointIndex, cores: DataFrame) -> DataFrame:
    """(block, s) with each point's core distance, infinite for points without."""
    placed = (index.points.select("vid", "block", "pos").join(cores, "vid", "left")
              .withColumn("core", F.coalesce("core", F.lit(float("inf")))))
    return placed.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "core"))),
                                                   lambda x: F.struct(x["core"].alias("core"))).alias("s"))


def _key_cores(index: PointIndex, cores: DataFrame) -> DataFrame:
    """(block, s) with the core distances of all points of each point's brand and key:
    one, or several where a key repeats, or none."""
    points = index.points.select("g", "key", "vid", "block", "pos")
    known = points.join(cores, "vid").groupBy("g", "key").agg(F.collect_list("core").alias("cores"))
    placed = points.join(known, ["g", "key"], "left").withColumn(
        "cores", F.coalesce("cores", F.array().cast("array<double>")))
    return placed.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cores"))),
                                                   lambda x: F.struct(x["cores"].alias("cores"))).alias("s"))


def pairs_within(index: PointIndex, eps: float, key_type: str, cores: DataFrame | None = None) -> DataFrame:
    """(g, a, b, d): keys of all pairs of points at most eps apart, the one that
    comes first as a. With ``cores`` (vid, core) also mr, the mutual reachability, a row for
    each two core distances of their keys; pairs of which one has none are left out."""
    pairs = _within(index, eps)

    def compare(a: dict, b: dict, same: bool, metric: str):
        d, off = rough(a["x"], b["x"], metric)
        i, j = np.nonzero(d <= eps + off)
        if same:
            i, j = i[i < j], j[i < j]
        d = exact(a["x"][i], b["x"][j], metric)
        ok = d <= eps
        i, j, d = i[ok], j[ok], d[ok]
        mr = ()
        if "cores" in a:
            m, n = (np.array([len(c) for c in x["cores"]]) for x in (a, b))
            flat_a, flat_b = (np.concatenate([*x["cores"], np.empty(0)]) for x in (a, b))
            many = m[i] * n[j]
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            i, j, d = np.repeat(i, many), np.repeat(j, many), np.repeat(d, many)
            ca = flat_a[(np.cumsum(m) - m)[i] + place // np.maximum(n[j], 1)]
            cb = flat_b[(np.cumsum(n) - n)[j] + place % np.maximum(n[j], 1)]
            mr = (np.maximum(np.maximum(ca, cb), d),)
        swap = a["vids"][i] > b["vids"][j]
        keys = pa.concat_arrays([a["keys"], b["keys"]])
        j = j + len(a["vids"])
        return keys.take(pa.array(np.where(swap, j, i))), keys.take(pa.array(np.where(swap, i, j))), d, *mr
    kind = dict(index.points.dtypes)["g"]
    schema = f"g {kind}, a {key_type}, b {key_type}, d double" + (", mr double" if cores is not None else "")
    return meet(index, pairs, compare, schema, _key_cores(index, cores) if cores is not None else None, named=True)


def _hang(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the parts of i and j in place; root names each point's part by its least point."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def links_within(index: PointIndex, eps: float, cores: DataFrame | None = None) -> DataFrame:
    """(a, b): vids whose links connect what all pairs within eps connect (with ``cores``:
    pairs whose mutual reachability is within eps). A tile returns a star for each of its
    connected parts, so there are never more links than points in the tiles."""
    def connect(met, metric: str):
        start, vids, root = {}, [], np.empty(0, np.int64)
        for a, b, same in met:
            for x in (a, b):
                if id(x) not in start:
                    start[id(x)] = len(root)
                    vids.append(x["vids"])
                    root = np.concatenate((root, np.arange(len(root), len(root) + len(x["vids"]))))
            at, to = start[id(a)], start[id(b)]
            p, q = root[at:at + len(a["vids"])], root[to:to + len(b["vids"])]
            if len(p) and (p == p[0]).all() and (q == p[0]).all():
                continue
            d, off = rough(a["x"], b["x"], metric)
            near = (d <= eps + off) & (p[:, None] != q)
            if "core" in a:
                near &= (a["core"] <= eps)[:, None] & (b["core"] <= eps)
            i, j = np.nonzero(near)
            ok = exact(a["x"][i], b["x"][j], metric) <= eps
            _hang(root, at + i[ok], to + j[ok])
        vids = np.concatenate(vids)
        i = np.flatnonzero(root != np.arange(len(root)))
        return vids[i], vids[root[i]]
    state = core_states(index, cores) if cores is not None else None
    return meet(index, _within(index, eps), connect, "a long, b long", state, whole=True)


def _upper_bounds(a: dict, b: dict, same: bool, metric: str, k: int):
    """Per point of a block a distance within which it has k neighbours in the block."""
    d, off = rough(a["x"], a["x"], metric)
    np.fill_diagonal(d, 0)
    own = np.eye(len(d), dtype=np.int64)
    order = np.argsort(d, axis=1)
    count = np.cumsum(a["copies"][order] - np.take_along_axis(own, order, axis=1), axis=1)
    short = count < k
    at = np.where(short.all(axis=1), len(d) - 1, short.sum(axis=1).clip(max=len(d) - 1))
    r = np.take_along_axis(d, np.take_along_axis(order, at[:, None], 1), 1)[:, 0] + off
    return np.where(short.all(axis=1), np.inf, r)


def kth_distances(index: PointIndex, k: int) -> DataFrame:
    """(vid, core): exact distance to the k-th nearest other point, copies counted.
    Points with fewer than k others in their brand have no row.

    A point first looks into its own block; the distance within which that holds k
    neighbours is how far the others are searched, so only points near a box's rim
    look any further.
    """
    own = index.blocks.select("block", F.col("block").alias("other"))

    def bounds(a: dict, b: dict, same: bool, metric: str):
        return a["vids"], _upper_bounds(a, b, same, metric, k)
    upper = meet(index, own, bounds, "vid long, r double").transform(saved)
    placed = index.points.select("vid", "block", "pos").join(upper, "vid")
    state = placed.groupBy("block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "r"))), lambda x: F.struct(x["r"].alias("r"))).alias("s"))
    radius = placed.groupBy("block").agg(F.max("r").alias("r"))

    def nearest(met, metric: str):
        best = {}  # of each block: what its points have found, and how far they still look
        for a, b, same in met:
            *had, r = best.get(id(a), (*_NOTHING, a["r"]))
            d, off = rough(a["x"], b["x"], metric)
            i, j = np.nonzero(d <= r[:, None] + off)
            d = exact(a["x"][i], b["x"][j], metric)
            copies = b["copies"][j] - (same & (i == j))
            some = copies > 0
            i, d, copies = (np.concatenate(x) for x in zip(had[1:], (i[some], d[some], copies[some])))
            order = np.lexsort((d, i))
            i, d, copies = i[order], d[order], copies[order]
            first = np.searchsorted(i, i)
            total = np.cumsum(copies)
            before = total - copies - (total - copies)[first]
            keep = before < k
            enough = keep & (before + copies >= k)
            r = r.copy()
            r[i[enough]] = np.minimum(r[i[enough]], d[enough])
            best[id(a)] = a["vids"], i[keep], d[keep], copies[keep], r
        return tuple(np.concatenate(x) for x in zip(*((v[i], d, c) for v, i, d, c, _ in best.values())))
    found = meet(index, near_blocks(index, radius), nearest, "vid long, d double, copies long", state, whole=True)
    run = Window.partitionBy("vid").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return (found.withColumn("run", F.sum("copies").over(run)).filter(F.col("run") >= k)
            .groupBy("vid").agg(F.min("d").alias("core")))


_NOTHING = (None, np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
