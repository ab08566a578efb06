"""End-to-end flows composed from sources, functions, operators and sinks.

``run_catalog``: catalog tables -> batches -> extract -> process -> vectors ->
clusters -> every sink and the ledger, batch by batch, each committed at once;
resumed from plan and ledger. ``run_csv`` differs in its source. ``run_postprocess``: batch outputs -> representatives ->
validation -> the four-column master. The smaller blocks below are what the
registered queries use.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import results as res
from ..operators.batching import (
    LEDGER_SCHEMA, assign_batches, batch_summary, brand_ledger_rows, failed_brands, global_summary,
    remaining_brands, union_batches)
from ..operators.cluster import ClusterConfig, cluster_products, identity_grouped
from ..operators.embed import embed
from ..operators.extract import brand_rollup, catalog_extract
from ..operators.prepare import IdentityConfig, process_products
from ..session import ensure_checkpoint_dir, saved
from ..sinks import writers
from ..sinks.snapshots import SnapshotStore
from ..sources.catalog import Catalog, derive_catalog, read_table
from ..sources.files import read_products_csv


@dataclass(frozen=True)
class RunConfig:
    identity: IdentityConfig = field(default_factory=IdentityConfig)
    cluster: ClusterConfig = field(default_factory=ClusterConfig)
    encoder: object = "hashed"
    batch_size: int = 1000


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_extract(derive_catalog(spark, sf_dir))


def processed(spark: SparkSession, sf_dir: str, cfg: IdentityConfig = IdentityConfig()) -> DataFrame:
    return process_products(products(spark, sf_dir), cfg)


def identity_detailed(spark: SparkSession, sf_dir: str, cfg: IdentityConfig = IdentityConfig()) -> DataFrame:
    """Processed rows clustered by exact identity (the minimum slice)."""
    return identity_grouped(processed(spark, sf_dir, cfg))


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as points: brandId = label, brandSKUId = vec_id."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("string").alias("brandId"), F.col("vec_id").alias("brandSKUId"),
                    "embedding")


def embedding_clusters(spark: SparkSession, sf_dir: str, eps: float, min_samples: int,
                       min_cluster_size: int = 2, method: str = "density") -> DataFrame:
    cfg = ClusterConfig(min_cluster_size=min_cluster_size, min_samples=min_samples, epsilon=eps,
                        method=method)
    return cluster_products(embedding_points(spark, sf_dir), cfg)


def catalog_run(spark: SparkSession, sf_dir: str, cfg: RunConfig = RunConfig()) -> DataFrame:
    """E1 without sinks: detailed rows (processed + cluster_id + batch_number)."""
    cat = derive_catalog(spark, sf_dir)
    batches = assign_batches(brand_rollup(cat), cfg.batch_size).select("brandId", "batch_number")
    p = process_products(catalog_extract(cat, exclude_test=True), cfg.identity).checkpoint()
    pts = embed(p, cfg.encoder)
    assigned = cluster_products(pts.select("brandId", "brandSKUId", "embedding"), cfg.cluster)
    return res.assign_clusters(p, assigned).join(batches, "brandId", "left")


def open_store(spark: SparkSession, out: str) -> SnapshotStore:
    """The tables of the runs under ``out``: brands (K1), detailed (K2), cluster_summary
    (K3), master (K4), master_summary (K5), combined (K6), batches (K8), plan, ledger."""
    return SnapshotStore(spark, out)


def stage_outputs(store: SnapshotStore, detailed: DataFrame, cfg: RunConfig = RunConfig()) -> dict[str, dict]:
    """K1-K4, K6 and K8 of detailed rows with ``batch_number``, staged; brands and
    batches that are there already are replaced."""
    meta = {"model": cfg.encoder if isinstance(cfg.encoder, str) else "callable",
            "min_cluster_size": cfg.cluster.min_cluster_size, "min_samples": cfg.cluster.min_samples}
    sinks = {"brands": (writers.brand_json_rows(detailed, **meta), "brandId", "json"),
             "detailed": (writers.detailed_rows(detailed), "brandId", "csv"),
             "cluster_summary": (writers.cluster_summary_rows(detailed), "brandId", "csv"),
             "master": (writers.master_rows(detailed), "brandId", "parquet"),
             "combined": (res.brand_document(detailed, **meta), "brandId", "json"),
             "batches": (writers.master_rows(detailed), "batch_number", "parquet")}
    return {name: store.stage(name, rows, key, fmt) for name, (rows, key, fmt) in sinks.items()}


def _table(store: SnapshotStore, name: str, schema: str) -> DataFrame:
    found = store.read(name)
    return store.spark.createDataFrame([], schema) if found is None else found


def _ledger(store: SnapshotStore) -> DataFrame:
    return _table(store, "ledger", LEDGER_SCHEMA)


def _clustered(products: DataFrame, brands: DataFrame, cfg: RunConfig) -> DataFrame:
    """Detailed rows of some brands (brandId, batch_number), written."""
    p = process_products(products.join(brands.select("brandId"), "brandId", "left_semi"), cfg.identity).transform(saved)
    assigned = cluster_products(embed(p, cfg.encoder).select("brandId", "brandSKUId", "embedding"), cfg.cluster)
    return res.assign_clusters(p, assigned).join(brands.select("brandId", "batch_number"), "brandId").transform(saved)


def _isolated(products: DataFrame, brands: DataFrame, cfg: RunConfig) -> tuple[list[DataFrame], list[tuple[str, str]]]:
    """Detailed rows of a batch, and (brand, error) for each brand that raises: a batch
    that raises is halved until such brands stand alone. The driver holds the brand ids
    of one batch."""
    try:
        return [_clustered(products, brands, cfg)], []
    except Exception as error:
        ids = sorted(r.brandId for r in brands.select("brandId").collect())
        if len(ids) == 1:
            lines = [x.strip() for x in str(error).splitlines() if x.strip()]
            return [], [(ids[0], " / ".join([*lines[:1], *lines[-1:]])[:500])]
        frames, failed = [], []
        for part in (ids[:len(ids) // 2], ids[len(ids) // 2:]):
            found, bad = _isolated(products, brands.filter(F.col("brandId").isin(part)), cfg)
            frames, failed = frames + found, failed + bad
        if not frames:  # nothing works: no single brand's fault
            raise
        return frames, failed


def _run_batches(products: DataFrame, batches: DataFrame, store: SnapshotStore, run_id: str, cfg: RunConfig) -> None:
    """Batch by batch: process, cluster, stage every output and the ledger rows, and
    commit them by one manifest line. A run that dies leaves whole batches only."""
    spark = store.spark
    ensure_checkpoint_dir(spark)
    for number in [r.batch_number for r in batches.select("batch_number").distinct().orderBy("batch_number").collect()]:
        started, brands = time.time(), batches.filter(F.col("batch_number") == number)
        frames, failed = _isolated(products, brands, cfg)
        staged, good = {}, brands
        ledger = spark.createDataFrame([], LEDGER_SCHEMA)
        if failed:
            rows = spark.createDataFrame(failed, "brandId string, error string")
            good = brands.join(rows, "brandId", "left_anti")
            ledger = rows.select(F.lit(run_id).alias("run_id"), "brandId", F.lit("failed").alias("status"), "error",
                                 F.lit(number).alias("batch_number"), F.timestamp_seconds(F.lit(started)).alias("started"),
                                 F.current_timestamp().alias("ts"))
        if frames:
            detailed = union_batches(*frames)
            if not detailed.isEmpty():
                staged = stage_outputs(store, detailed, cfg)
            ledger = ledger.unionByName(brand_ledger_rows(detailed, good, run_id, started))
        staged["ledger"] = store.stage("ledger", ledger, "batch_number", replace=False)
        store.commit(staged)
    master = store.read("master")
    if master is not None:
        summary = (res.master_summary(master).withColumn("processing_timestamp", F.current_timestamp())
                   .withColumn("scope", F.lit("all")))
        store.replace("master_summary", summary, "scope", fmt="json")


def plan_batches(store: SnapshotStore, todo: DataFrame, size: int) -> DataFrame:
    """(brandId, batch_number) of brands to do (brandId, product_count): those whose
    planned batch was never committed keep it, others come in new batches; the plan is
    committed before any work."""
    plan = _table(store, "plan", "brandId string, batch_number int")
    todo = todo.withColumn("brandId", F.col("brandId").cast("string"))
    done = _ledger(store).select("batch_number").distinct()
    open_ = plan.join(done, "batch_number", "left_anti").join(todo.select("brandId"), "brandId", "left_semi").select(
        "brandId", "batch_number").checkpoint()
    last = plan.agg(F.coalesce(F.max("batch_number"), F.lit(0))).first()[0]
    new = assign_batches(todo.join(open_, "brandId", "left_anti"), size, start=last + 1).select(
        "brandId", "batch_number").checkpoint()
    if not new.isEmpty():
        store.replace("plan", new, "batch_number", replace=False)
    return open_.union(new).checkpoint()


def _run_summary(store: SnapshotStore, run_id: str) -> DataFrame:
    mine = _ledger(store).filter(F.col("run_id") == run_id)
    empty = "brandId string, batch_number int, cluster_id int"
    detailed = _table(store, "batches", empty).join(mine.select("batch_number").distinct(), "batch_number", "left_semi")
    return batch_summary(detailed, mine)


def run_catalog(cat: Catalog, out: str, run_id: str, cfg: RunConfig = RunConfig(),
                exclude: DataFrame | None = None) -> DataFrame:
    """All brands that the ledger under ``out`` does not name as processed, in committed
    batches; failed brands are tried again, and batches that an earlier run planned and
    did not commit are done as planned. Returns the batch summaries of the run."""
    store = open_store(cat.sku.sparkSession, out)
    ensure_checkpoint_dir(store.spark)
    todo = remaining_brands(brand_rollup(cat, exclude=exclude), _ledger(store))
    _run_batches(catalog_extract(cat, exclude_test=True), plan_batches(store, todo, cfg.batch_size), store, run_id, cfg)
    return _run_summary(store, run_id)


def retry_failed(cat: Catalog, out: str, run_id: str, cfg: RunConfig = RunConfig()) -> DataFrame:
    """Only the brands whose latest state is failed, in batches of their own."""
    store = open_store(cat.sku.sparkSession, out)
    ensure_checkpoint_dir(store.spark)
    todo = brand_rollup(cat).join(failed_brands(_ledger(store)), "brandId", "left_semi")
    _run_batches(catalog_extract(cat, exclude_test=True), plan_batches(store, todo, cfg.batch_size), store, run_id, cfg)
    return _run_summary(store, run_id)


def run_csv(spark: SparkSession, paths, out: str, run_id: str, cfg: RunConfig = RunConfig()) -> DataFrame:
    """The same from product CSV files, one brand per file name, resumed alike; one row
    of totals."""
    products = read_products_csv(spark, paths)
    store = open_store(spark, out)
    ensure_checkpoint_dir(spark)
    brands = remaining_brands(products.groupBy("brandId").agg(F.count(F.lit(1)).alias("product_count")), _ledger(store))
    _run_batches(products, plan_batches(store, brands, cfg.batch_size), store, run_id, cfg)
    return global_summary(_run_summary(store, run_id))


def run_postprocess(master: DataFrame, path: str) -> DataFrame:
    """Representatives of batch outputs (``read_batches`` or a master table),
    validated and written (K9); returns their statistics (O15)."""
    reps = res.representatives(master).checkpoint()
    if not res.validate_representatives(reps).isEmpty():
        raise ValueError("a cluster has more than one representative")
    writers.write_representatives(reps, path)
    return res.master_stats(reps)
