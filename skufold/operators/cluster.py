"""Per-brand clustering (C4, C6-C9) and the exact-identity grouping.

Input ``points``: (brandId, brandSKUId, embedding array<float|double>).
Output: (brandId, brandSKUId, cluster_id int), -1 = noise ("no sisters").
Cluster ids are brand-local; the key of a cluster is (brandId, cluster_id).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir, saved, scratch_path
from .components import connected_components
from . import hierarchy, mst, pivots
from .sizing import cpu_partitions
from .vectors import euclidean

GROUP, KEY, VEC = "brandId", "brandSKUId", "embedding"

# Fixed values (must equal the reference): size thresholds of the adaptive
# parameters and the k-means route, and the k rule.
LARGE_BRAND = 1000          # > : min_cluster_size >= 5, min_samples >= 3, manhattan
LARGE_MIN_CLUSTER_SIZE = 5
LARGE_MIN_SAMPLES = 3
KMEANS_BRAND = 2000         # > : k-means
KMEANS_K_DIVISOR, KMEANS_K_MIN, KMEANS_K_MAX = 20, 10, 100
KMEANS_SEED, KMEANS_N_INIT = 42, 10


@dataclass(frozen=True)
class ClusterConfig:
    """Method and parameters, the same for brands of any size; nothing switches
    by size. ``adaptive_params`` reports the sizes the reference recommends."""
    method: str = "density"            # or "hdbscan", "kmeans"
    metric: str = "euclidean"          # or "manhattan"
    min_cluster_size: int = 2
    min_samples: int = 1
    epsilon: float = 0.1
    k: int | None = None               # k-means clusters per brand; None: the fixed rule
    kmeans_n_init: int = KMEANS_N_INIT
    kmeans_max_iter: int | None = None  # None: to convergence; not converged by then: an error, never labels
    kmeans_tol: float = 1e-6
    kmeans_seed: int = KMEANS_SEED
    kmeans_seeding: str = "hash"       # or "first": the smallest ids, for one reproducible start
    rows_per_salt: int = 16384


def k_rule(n: F.Column) -> F.Column:
    k = F.least(F.greatest(F.floor(n / KMEANS_K_DIVISOR), F.lit(KMEANS_K_MIN)), F.lit(KMEANS_K_MAX))
    return F.least(k, n).cast("int")


def adaptive_params(points: DataFrame, cfg: ClusterConfig) -> DataFrame:
    """C6 + C7: one row per brand with n and the recommended route, _mcs, _ms,
    _metric, _eps, k. A report; it routes nothing."""
    n = F.col("n")
    big = n > LARGE_BRAND
    return (points.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n"))
            .select(GROUP, "n", F.when(n > KMEANS_BRAND, "kmeans").otherwise("density").alias("route"),
                    F.when(big, F.greatest(F.lit(cfg.min_cluster_size), F.lit(LARGE_MIN_CLUSTER_SIZE)))
                    .otherwise(F.lit(cfg.min_cluster_size)).alias("_mcs"),
                    F.when(big, F.greatest(F.lit(cfg.min_samples), F.lit(LARGE_MIN_SAMPLES)))
                    .otherwise(F.lit(cfg.min_samples)).alias("_ms"),
                    F.when(big, F.lit("manhattan")).otherwise(F.lit(cfg.metric)).alias("_metric"),
                    F.lit(float(cfg.epsilon)).alias("_eps"), k_rule(n).alias("k")))


def brand_ranks(keys: DataFrame, order: str) -> DataFrame:
    """(brandId, order) distinct rows -> + cluster_id 0.. by order in each brand.

    Range partitions give every brand's keys in order; a row's id is the count in
    the partitions before its own plus its place there, so a brand with very many
    clusters is not ranked in one task.
    """
    ensure_checkpoint_dir(keys.sparkSession)
    t = (keys.select(GROUP, order).repartitionByRange(GROUP, order)
         .withColumn("_p", F.spark_partition_id()).checkpoint())
    before = Window.partitionBy(GROUP).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (t.groupBy(GROUP, "_p").agg(F.count(F.lit(1)).alias("_c"))
               .select(GROUP, "_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off")))
    inside = Window.partitionBy(GROUP, "_p").orderBy(order)
    return (t.join(offsets, [GROUP, "_p"])
            .select(GROUP, order, (F.col("_off") + F.row_number().over(inside) - 1).cast("int").alias("cluster_id")))


def number_clusters(members: DataFrame, root: str = "root") -> DataFrame:
    """Brand-local ids 0..k-1 ordered by each cluster's root key.

    ``members``: (brandId, brandSKUId, root). The rank runs over the cluster
    table (one row per cluster), never over SKU rows.
    """
    ids = brand_ranks(members.select(GROUP, root).distinct(), root)
    return members.join(ids, [GROUP, root]).select(GROUP, KEY, "cluster_id")


def _attach_noise(points: DataFrame, assigned: DataFrame) -> DataFrame:
    return (points.select(GROUP, KEY).join(assigned, [GROUP, KEY], "left")
            .select(GROUP, KEY, F.coalesce("cluster_id", F.lit(-1)).cast("int").alias("cluster_id")))


def identity_grouped(processed: DataFrame, min_cluster_size: int = 2,
                     identity: str = "core_identity") -> DataFrame:
    """Exact grouping, returned as the processed rows plus ``cluster_id``:
    SKUs of a brand with equal identity strings form a cluster when there are
    at least ``min_cluster_size`` of them.

    The processed rows are written once, as a table, so normalization runs once however
    often they are read, and a reader takes only the columns it names.
    """
    processed = saved(processed)
    sizes = processed.groupBy(GROUP, identity).agg(F.count(F.lit(1)).alias("_n"))
    ids = brand_ranks(sizes.filter(F.col("_n") >= min_cluster_size), identity)
    return (processed.join(ids, [GROUP, identity], "left")
            .withColumn("cluster_id", F.coalesce(F.col("cluster_id"), F.lit(-1)).cast("int")))


def identity_clusters(processed: DataFrame, min_cluster_size: int = 2,
                      identity: str = "core_identity") -> DataFrame:
    """Exact grouping as an assignment (brandId, brandSKUId, cluster_id)."""
    return identity_grouped(processed, min_cluster_size, identity).select(GROUP, KEY, "cluster_id")


def density_clusters(points: DataFrame, cfg: ClusterConfig = ClusterConfig()) -> DataFrame:
    """C4: flat density cut.

    Equal vectors of a brand are one vertex with a count, so copies never pair up.
    Edges: eps-neighbour pairs whose mutual reachability max(core a, core b, d)
    is <= eps; core distances count every copy. A tile of pairs returns what its edges
    connect, not the edges. Clusters: connected components with >= min_cluster_size SKUs. Everything else, SKUs
    without a vector included, is noise.
    """
    ensure_checkpoint_dir(points.sparkSession)
    usable = points.select(GROUP, KEY, VEC).filter(F.col(VEC).isNotNull())
    distinct = usable.groupBy(GROUP, VEC).agg(F.min(KEY).alias("rep"), F.count(F.lit(1)).alias("copies")).checkpoint()
    index = pivots.build(distinct.withColumnRenamed("rep", KEY), GROUP, KEY, VEC, cfg.metric, "copies")
    weights = distinct.select(GROUP, F.col("rep").alias("id"), "copies")
    named = lambda vid, key: index.points.select(F.col("vid").alias(vid), F.col("g").alias(GROUP), F.col("key").alias(key))
    cores = None
    if cfg.min_samples > 1:
        cores = pivots.kth_distances(index, cfg.min_samples).filter(F.col("core") <= cfg.epsilon).transform(saved)
    vertex = lambda vid, name: index.points.select(F.col("vid").alias(vid), F.struct("g", F.col("key").alias("k")).alias(name))
    links = pivots.links_within(index, cfg.epsilon, cores).join(vertex("a", "src"), "a").join(vertex("b", "dst"), "b")
    comp = connected_components(links)
    linked = comp.select(F.col("vertex.g").alias(GROUP), F.col("vertex.k").alias("rep"),
                         F.col("component.k").alias("root"))
    dense = weights.filter("copies > 1")  # copies are neighbours at distance 0
    if cores is not None:
        dense = dense.join(named("vid", "id").join(cores, "vid"), [GROUP, "id"], "left_semi")
    alone = dense.select(GROUP, F.col("id").alias("rep"), F.col("id").alias("root")).join(linked, [GROUP, "rep"], "left_anti")
    members = (distinct.select(GROUP, "rep", "copies").join(linked.union(alone), [GROUP, "rep"])).checkpoint()
    big = (members.groupBy(GROUP, "root").agg(F.sum("copies").alias("_n"))
           .filter(F.col("_n") >= cfg.min_cluster_size).select(GROUP, "root"))
    ids = brand_ranks(big, "root")
    by_vector = (distinct.join(members.select(GROUP, "rep", "root"), [GROUP, "rep"]).join(ids, [GROUP, "root"])
                 .select(GROUP, VEC, "cluster_id"))
    return _attach_noise(points, usable.join(by_vector, [GROUP, VEC]).select(GROUP, KEY, "cluster_id"))


def hdbscan_clusters(points: DataFrame, cfg: ClusterConfig = ClusterConfig()) -> DataFrame:
    """Hierarchical density clusters by excess of mass, selected no finer than
    ``epsilon``; a brand's whole tree is never one cluster.

    Equal vectors of a brand are one vertex with copies. Brands with at most
    ``min_samples`` points have no core distances and are noise, like SKUs without a
    vector.
    """
    ensure_checkpoint_dir(points.sparkSession)
    usable = points.select(GROUP, KEY, VEC).filter(F.col(VEC).isNotNull() & F.col(GROUP).isNotNull())
    distinct = usable.groupBy(GROUP, VEC).agg(F.min(KEY).alias("rep"), F.count(F.lit(1)).alias("copies")).transform(saved)
    index = pivots.build(distinct, GROUP, "rep", VEC, cfg.metric, "copies")
    vertices = index.points.select(F.col("g").alias(GROUP), "vid", F.col("key").alias("rep"), "copies").transform(saved)
    cores = pivots.kth_distances(index, cfg.min_samples).transform(saved)
    tree = hierarchy.merge_tree(mst.spanning_trees(index, cores), vertices.join(cores.select("vid"), "vid"))
    clusters, members = hierarchy.condensed(tree, cores, cfg.min_cluster_size)
    chosen = hierarchy.select_clusters(clusters, cfg.epsilon).filter("chosen is not null")
    found = (members.join(chosen, "c").join(vertices, "vid").select(GROUP, "rep", "chosen")).transform(saved)
    roots = found.groupBy(GROUP, "chosen").agg(F.min("rep").alias("root"))
    ids = brand_ranks(roots.select(GROUP, "root"), "root")
    by_vector = (distinct.join(found, [GROUP, "rep"]).join(roots, [GROUP, "chosen"]).join(ids, [GROUP, "root"])
                 .select(GROUP, VEC, "cluster_id"))
    return _attach_noise(points, usable.join(by_vector, [GROUP, VEC]).select(GROUP, KEY, "cluster_id"))


def _by_start(table: pa.Table) -> dict[int, np.ndarray]:
    """Centroid matrices by start, their rows by cid."""
    order = np.lexsort((table["cid"].to_numpy(), table["start"].to_numpy()))
    start = table["start"].to_numpy()[order]
    c = _matrix(table["c"])[order]
    return {int(x): c[start == x] for x in np.unique(start)}


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1)


#: Rows whose distances to all centroids of a start are held at once, bytes of a block of points, and
#: bytes (as doubles) of all points of a brand up to which a task takes a start through all its rounds.
_ROWS_AT_ONCE, _BLOCK_BYTES, _WHOLE_BYTES = 2048, 1 << 24, 1 << 26


def _nearest(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Number of each row's nearest centroid."""
    norms, at = (c * c).sum(axis=1), np.empty(len(v), np.int64)
    for i in range(0, len(v), _ROWS_AT_ONCE):
        at[i:i + _ROWS_AT_ONCE] = (norms - 2.0 * (v[i:i + _ROWS_AT_ONCE] @ c.T)).argmin(axis=1)
    return at


def _two_nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each row's nearest centroid, its distance, and that of the second one."""
    norms, at = (c * c).sum(axis=1), np.empty(len(v), np.int64)
    own, other = np.empty(len(v)), np.empty(len(v))
    for i in range(0, len(v), _ROWS_AT_ONCE):
        x = v[i:i + _ROWS_AT_ONCE]
        d = norms - 2.0 * (x @ c.T)
        rows, first, size = np.arange(len(x)), d.argmin(axis=1), (x * x).sum(axis=1)
        at[i:i + len(x)], own[i:i + len(x)] = first, np.sqrt(np.maximum(d[rows, first] + size, 0))
        d[rows, first] = np.inf
        other[i:i + len(x)] = np.sqrt(np.maximum(d.min(axis=1) + size, 0))
    return at, own, other


def _sums(v: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Points of each centroid, and their sum."""
    order = np.argsort(at, kind="stable")
    found, first, many = np.unique(at[order], return_index=True, return_counts=True)
    count, total = np.zeros(k, np.int64), np.zeros((k, v.shape[1]))
    count[found], total[found] = many, np.add.reduceat(v[order], first, axis=0)
    return count, total


def _lloyd(v: np.ndarray, c: np.ndarray, tol: float, rounds: int | None = None) -> tuple[np.ndarray, bool]:
    """Lloyd rounds of one start over all points of a brand: the centroids once none
    moves by more than tol, and whether any still did after ``rounds``.

    A point looks at all centroids again only when, by how far they have moved since it
    last did, another one may be nearer than its own. Sums follow the points that change
    sides, and are added up anew before a start counts as converged.
    """
    slack = 4e-7 * np.sqrt(2 * (v * v).sum(axis=1).max())  # rounding of a distance near 0
    at, own, other = _two_nearest(v, c)
    (count, total), fresh, done = _sums(v, at, len(c)), True, 0
    while rounds is None or done < rounds:
        new = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
        step = np.sqrt(((new - c) ** 2).sum(axis=1))
        if step.max() <= tol:
            if fresh:
                return new, False
            (count, total), fresh = _sums(v, at, len(c)), True
            continue
        c, done = new, done + 1
        widest = step.argmax()
        others = np.full(len(c), step[widest])
        others[widest] = np.delete(step, widest).max(initial=0.0)
        own += step[at]
        other -= others[at]
        look = np.flatnonzero(own + slack >= other)
        own[look] = np.sqrt(((v[look] - c[at[look]]) ** 2).sum(axis=1))
        look = look[own[look] + slack >= other[look]]
        was = at[look]
        at[look], own[look], other[look] = _two_nearest(v[look], c)
        left = was != at[look]
        moved, was = look[left], was[left]
        if len(moved) > len(v) // 16:
            (count, total), fresh = _sums(v, at, len(c)), True
        elif len(moved):
            np.subtract.at(total, was, v[moved])
            np.add.at(total, at[moved], v[moved])
            count += np.bincount(at[moved], minlength=len(c)) - np.bincount(was, minlength=len(c))
            fresh = False
    return c, True


def _vector_lists(m: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as an Arrow list column."""
    offsets = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.ListArray.from_arrays(offsets, np.ascontiguousarray(m).reshape(-1))


def _blocks(pts: DataFrame, key_type: str) -> DataFrame:
    """One row per (brand, salt): the keys, and the vectors as one matrix in bytes."""
    kind = pts.schema["v"].dataType.elementType.simpleString()
    group_type = pts.schema[GROUP].dataType.simpleString()
    ddl = f"{GROUP} {group_type}, _salt int, keys array<{key_type}>, width int, m binary"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def pack(rows: pa.Table) -> pa.Table:
        keys, m = rows[KEY].combine_chunks(), _matrix(rows["v"]).astype("<f4" if kind == "float" else "<f8", copy=False)
        lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        return pa.Table.from_arrays([rows[GROUP][:1].combine_chunks(), rows["_salt"][:1].combine_chunks(), lists,
                                     pa.array([m.shape[1]], pa.int32()), pa.array([m.tobytes()], pa.binary())],
                                    names=schema.names).cast(schema)
    return pts.select(GROUP, "_salt", KEY, "v").groupBy(GROUP, "_salt").applyInArrow(pack, ddl)


def _bucketed(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, written once to the shared folder in buckets of ``keys``, so that group-bys
    on them read it without a shuffle. The catalog entry is gone at once, the files
    stay as long as the folder does."""
    spark, n = df.sparkSession, cpu_partitions(df.sparkSession)
    name = f"bucketed_{uuid.uuid4().hex[:12]}"
    (df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys)
     .option("path", scratch_path(spark, "buckets")).saveAsTable(name))
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def kmeans_clusters(points: DataFrame, cfg: ClusterConfig = ClusterConfig()) -> DataFrame:
    """Grouped Lloyd iterations for all brands at once, to convergence.

    Points are written once in buckets of (brand, salt), the points of a salt packed
    into one block of bytes; a brand has ``ceil(n / rows_per_salt)`` salts, more if their
    blocks would pass 16 MB, so no brand sits in one task. Each
    iteration hands every (brand, salt) the brand's moving centroids, which meet
    the block in a co-group that moves, sorts and converts no point. It returns one partial sum per
    centroid, and partial sums are added per (brand, start, cid). Starts that have
    converged take no further part. Where all blocks of a brand fit a task
    (``_WHOLE_BYTES``), the same rounds need no exchange: a task takes a start through
    them. The best start per brand (lowest inertia) gives the labels. A round that moves a
    centroid lowers the inertia, so rounds end; centroids that still move after
    ``kmeans_max_iter`` rounds, if that is set, raise an error, and so do vectors that are
    not finite. SKUs without a vector get -1; the vectors of a brand have one
    length. Not bit-equal to scikit-learn's k-means++ runs.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    spark = points.sparkSession
    ensure_checkpoint_dir(spark)
    group_type, key_type = (points.schema[c].dataType.simpleString() for c in (GROUP, KEY))
    usable = points.filter(F.col(VEC).isNotNull())
    n = F.col("n")
    width = F.greatest(F.lit(1), F.col("_width"))
    per_salt = F.least(F.lit(cfg.rows_per_salt), F.greatest(F.lit(1), F.floor(F.lit(_BLOCK_BYTES // 8) / width)))
    prm = usable.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(VEC)).alias("_width")).select(
        GROUP, (k_rule(n) if cfg.k is None else F.least(F.lit(int(cfg.k)), n).cast("int")).alias("k"),
        F.greatest(F.lit(1), F.ceil(n / per_salt)).cast("int").alias("_salts"),
        (n * width * 8 <= _WHOLE_BYTES).alias("_whole")).checkpoint()
    exact = "float" if points.schema[VEC].dataType.elementType.simpleString() == "float" else "double"
    pts = (usable.select(GROUP, KEY, F.col(VEC).cast(f"array<{exact}>").alias("v")).join(prm, GROUP)
           .withColumn("_salt", F.pmod(F.xxhash64(F.col(KEY).cast("string")), F.col("_salts")).cast("int"))
           .select(GROUP, "_salt", KEY, "v", "k", "_whole"))
    pts = _bucketed(pts, [GROUP, "_salt"])
    blocks = _bucketed(_blocks(pts, key_type), [GROUP, "_salt"])
    # Initial centroids: per (brand, start) the k points with the smallest seeded
    # hash, or the smallest ids. Exact two-stage top-k over ids alone: within each
    # (brand, start, salt), then over the <= salts * k survivors.
    starts = F.sequence(F.lit(0), F.lit(int(cfg.kmeans_n_init) - 1))
    h = F.lit(0) if cfg.kmeans_seeding == "first" else F.xxhash64(
        F.col(KEY).cast("string"), F.col("start"), F.lit(cfg.kmeans_seed))
    cand = pts.select(GROUP, "_salt", KEY, "k", F.explode(starts).alias("start")).withColumn("_h", h)
    w1 = Window.partitionBy(GROUP, "start", "_salt").orderBy("_h", KEY)
    local = cand.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= F.col("k")).drop("_r")
    w2 = Window.partitionBy(GROUP, "start").orderBy("_h", KEY)
    seeds = (local.withColumn("cid", (F.row_number().over(w2) - 1).cast("int")).filter(F.col("cid") < F.col("k"))
             .select(GROUP, "_salt", KEY, "start", "cid"))
    # one centroid per cid: where a key repeats, its rows' vectors in their order
    same = F.col("p._salt").eqNullSafe(F.col("s._salt")) & F.col(f"p.{KEY}").eqNullSafe(F.col(f"s.{KEY}"))
    met = pts.alias("p").join(seeds.alias("s"), (F.col(f"p.{GROUP}") == F.col(f"s.{GROUP}")) & same)
    cents = (met.groupBy(f"p.{GROUP}", "start", f"p.{KEY}", "_whole")
             .agg(F.array_sort(F.collect_set("cid")).alias("cids"), F.array_sort(F.collect_list("v")).alias("vs"))
             .select(GROUP, "start", "_whole", "vs", F.size("cids").alias("m"), F.posexplode("cids").alias("i", "cid"))
             .select(GROUP, "start", "cid", F.element_at("vs", F.col("i") * F.col("m") + 1).cast("array<double>").alias("c"),
                     F.lit(True).alias("active"), "_whole").checkpoint())

    def vectors(packed: pa.Table) -> np.ndarray:
        """The points of packed blocks, as doubles."""
        parts = [np.frombuffer(m.as_buffer(), "<f4" if exact == "float" else "<f8").reshape(-1, w.as_py())
                 for m, w in zip(packed["m"], packed["width"])]
        return np.concatenate(parts, dtype=np.float64) if len(parts) > 1 else parts[0].astype(np.float64, copy=False)

    def meet(cents: DataFrame, fn, schema: str) -> DataFrame:
        """fn(keys, points' matrix, centroids by start) -> columns, per (brand, salt)."""
        spread = (cents.join(prm.select(GROUP, "_salts"), GROUP)
                  .select(F.col(GROUP).alias(GROUP), F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"),
                          "start", "cid", "c"))

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not (len(left) and len(right)):
                return out_schema.empty_table()
            cols = fn(left["keys"].combine_chunks().flatten(), vectors(left), _by_start(right))
            brand = pa.repeat(left[GROUP][0], len(cols[0]))
            return pa.Table.from_arrays([brand, *cols], schema=out_schema)
        out_schema = to_arrow_schema(StructType.fromDDL(f"{GROUP} {group_type}, {schema}"))
        return (blocks.groupBy(GROUP, "_salt").cogroup(spread.groupBy(GROUP, "_salt"))
                .applyInArrow(run, f"{GROUP} {group_type}, {schema}"))

    def sums(keys, v, by_start):
        start, cid, count, total = [], [], [], []
        for s, c in by_start.items():
            many, added = _sums(v, _nearest(v, c), len(c))
            found = np.flatnonzero(many)
            start += [s] * len(found)
            cid += found.tolist()
            count += many[found].tolist()
            total.append(added[found])
        return [pa.array(start, pa.int32()), pa.array(cid, pa.int32()), pa.array(count, pa.int64()),
                _vector_lists(np.concatenate(total))]

    def inertia(keys, v, by_start):
        return [pa.array(list(by_start), pa.int32()),
                pa.array([float(((v - c[_nearest(v, c)]) ** 2).sum(axis=1).sum()) for c in by_start.values()], pa.float64())]

    def labels(keys, v, by_start):
        (c,) = by_start.values()
        return [keys, pa.array(_nearest(v, c).astype(np.int32))]

    def rounds(packed: pa.Table, right: pa.Table) -> pa.Table:
        if not (len(packed) and len(right)):
            return whole_schema.empty_table()
        ((start, c),) = _by_start(right).items()
        v = vectors(packed.sort_by("_salt"))
        if not np.isfinite(v).all():
            raise ValueError("k-means: a vector is not finite")
        c, moving = _lloyd(v, c, cfg.kmeans_tol, limit)
        cols = [pa.repeat(packed[GROUP][0], len(c)), pa.array([start] * len(c), pa.int32()), pa.array(range(len(c)), pa.int32()),
                _vector_lists(c), pa.array([moving] * len(c))]
        return pa.Table.from_arrays(cols, schema=whole_schema)
    limit = None if cfg.kmeans_max_iter is None else int(cfg.kmeans_max_iter)
    whole_ddl = f"{GROUP} {group_type}, start int, cid int, c array<double>, active boolean"
    whole_schema = to_arrow_schema(StructType.fromDDL(whole_ddl))
    # one task per (brand, start); explicit partitions, as tasks cost far more than their bytes
    dealt = lambda df: df.repartition(cpu_partitions(spark), GROUP, "start").groupBy(GROUP, "start")
    copies = _blocks(pts.filter("_whole"), key_type).select(GROUP, "_salt", "width", "m", F.explode(starts).alias("start"))
    whole = (dealt(copies).cogroup(dealt(cents.filter("_whole").drop("_whole", "active"))).applyInArrow(rounds, whole_ddl)).checkpoint()
    cents, done = cents.filter("not _whole").drop("_whole"), 0
    still = "k-means still moves after {} rounds: raise kmeans_max_iter or kmeans_tol"
    if limit is not None and not whole.filter("active").isEmpty():
        raise RuntimeError(still.format(limit))
    while not cents.filter("active").isEmpty():
        if done == limit:
            raise RuntimeError(still.format(limit))
        means = (meet(cents.filter("active"), sums, "start int, cid int, n long, s array<double>")
                 .groupBy(GROUP, "start", "cid")
                 .agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("s")).alias("s"))
                 .select(GROUP, "start", "cid", F.transform(vector_to_array("s"), lambda x: x / F.col("n")).alias("nc")))
        step = F.max(F.coalesce(euclidean(F.col("c"), F.col("nc")), F.lit(0.0))).over(Window.partitionBy(GROUP, "start"))
        step = F.when(F.isnan(step), F.raise_error(F.lit("k-means: a vector is not finite")).cast("double")).otherwise(step)
        cents = (cents.join(means, [GROUP, "start", "cid"], "left").withColumn("active", step > cfg.kmeans_tol)
                 .select(GROUP, "start", "cid", F.coalesce("nc", "c").alias("c"), "active").checkpoint())
        done += 1
    cents = cents.union(whole)
    if int(cfg.kmeans_n_init) > 1:
        best = (meet(cents, inertia, "start int, e double").groupBy(GROUP, "start").agg(F.sum("e").alias("e"))
                .groupBy(GROUP).agg(F.min_by("start", F.struct("e", "start")).alias("start")))
        cents = cents.join(best, [GROUP, "start"])
    return _attach_noise(points, meet(cents, labels, f"{KEY} {key_type}, cluster_id int"))


def cluster_products(points: DataFrame, cfg: ClusterConfig = ClusterConfig()) -> DataFrame:
    """Cluster every brand by the method the caller names."""
    methods = {"density": density_clusters, "hdbscan": hdbscan_clusters, "kmeans": kmeans_clusters}
    if cfg.method not in methods:
        raise ValueError(f"unknown method {cfg.method!r}")
    return methods[cfg.method](points, cfg)


def clustering_stats(assigned: DataFrame) -> DataFrame:
    """Per brand clusters (excluding -1), noise and clustered counts."""
    cid = F.col("cluster_id")
    return assigned.groupBy(GROUP).agg(
        F.count_distinct(F.when(cid != -1, cid)).alias("n_clusters"),
        F.sum(F.when(cid == -1, 1).otherwise(0)).alias("n_noise"),
        F.sum(F.when(cid != -1, 1).otherwise(0)).alias("n_clustered"))
