"""Batches, resume and the run ledger.

The ledger is an append-only table (run_id, brandId, status, error, batch_number,
started, ts); the latest row per brand is its state. Brand lists are
brand-level tables (tens of thousands of rows), so the single global
row_number of B1 is over brands only, never SKUs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEDGER_SCHEMA = ("run_id string, brandId string, status string, error string, "
                 "batch_number int, started timestamp, ts timestamp")


def assign_batches(brands: DataFrame, size: int, start: int = 1) -> DataFrame:
    """B1: brands ordered by product_count desc, id -> batch numbers from
    ``start``; ceil(n / size) batches."""
    w = Window.orderBy(F.desc("product_count"), "brandId")
    return brands.withColumn("_rn", F.row_number().over(w)).withColumn(
        "batch_number", (F.lit(start) + F.floor((F.col("_rn") - 1) / size)).cast("int")).drop("_rn")


def ledger_state(ledger: DataFrame) -> DataFrame:
    """Latest status per brand."""
    started = F.col("started") if "started" in ledger.columns else F.lit(None).cast("timestamp").alias("started")
    last = F.max_by(F.struct("status", "error", "batch_number", started, "ts"), F.struct("ts", "run_id"))
    return ledger.groupBy("brandId").agg(last.alias("r")).select("brandId", "r.*")


def remaining_brands(brands: DataFrame, ledger: DataFrame) -> DataFrame:
    """B2: all brands minus the processed ones (failed brands stay)."""
    done = ledger_state(ledger).filter(F.col("status") == "processed").select("brandId")
    return brands.join(done, "brandId", "left_anti")


def resume_point(batch_numbers: DataFrame, col: str = "batch_number") -> DataFrame:
    """Last batch of the unbroken run 1..n present, and the next one."""
    b = batch_numbers.select(F.col(col).cast("int").alias("b")).filter(F.col("b") >= 1).distinct()
    w = Window.orderBy("b")
    run = b.withColumn("rn", F.row_number().over(w)).filter(F.col("b") == F.col("rn"))
    return run.agg(F.coalesce(F.max("b"), F.lit(0)).alias("last_completed")) \
        .withColumn("next_batch", F.col("last_completed") + 1)


def completed_batches(ledger: DataFrame) -> DataFrame:
    """B4 input: batches of which every brand's latest state is processed."""
    done = F.min((F.col("status") == "processed").cast("int")) == 1
    return ledger_state(ledger).groupBy("batch_number").agg(done.alias("_d")).filter("_d").select("batch_number")


def failed_brands(ledger: DataFrame) -> DataFrame:
    """B5 input: brands whose latest state is failed."""
    return ledger_state(ledger).filter(F.col("status") == "failed").select("brandId")


def upsert_by_brand(master: DataFrame, new: DataFrame) -> DataFrame:
    """Replace every brand present in ``new``; idempotent."""
    return master.join(new.select("brandId").distinct(), "brandId", "left_anti").unionByName(
        new, allowMissingColumns=True)


def union_batches(*frames: DataFrame) -> DataFrame:
    """B7"""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def brand_ledger_rows(products: DataFrame, brands: DataFrame, run_id: str, started: float | None = None) -> DataFrame:
    """One ledger row per brand of the batch. Row-level errors do not fail a
    brand (they become fallback rows, ``row_status``); a brand of which no row
    could be processed is failed, with an error text, and others go on. A brand
    with no rows is processed."""
    bad = F.sum(F.when(F.col("row_status") != "ok", 1).otherwise(0)) if "row_status" in products.columns else F.lit(0)
    per = products.groupBy("brandId").agg(F.count(F.lit(1)).alias("_n"), bad.alias("_bad"))
    failed = F.coalesce((F.col("_n") > 0) & (F.col("_bad") == F.col("_n")), F.lit(False))
    return (brands.select("brandId", "batch_number").join(per, "brandId", "left")
            .select(F.lit(run_id).alias("run_id"), F.col("brandId").cast("string"),
                    F.when(failed, "failed").otherwise("processed").alias("status"),
                    F.when(failed, F.concat(F.lit("none of "), F.col("_n").cast("string"),
                                            F.lit(" rows could be processed"))).alias("error"),
                    F.col("batch_number").cast("int"),
                    (F.current_timestamp() if started is None else F.timestamp_seconds(F.lit(started))).alias("started"),
                    F.current_timestamp().alias("ts")))


def batch_summary(detailed: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per batch brands in / processed / failed, the failed ones' ids, minutes from
    start to end, products, clusters, clustered, rate. A batch is at most a batch size
    of brands."""
    st = ledger_state(ledger)
    brands = st.groupBy("batch_number").agg(
        F.count(F.lit(1)).alias("brands_in_batch"),
        F.sum(F.when(F.col("status") == "processed", 1).otherwise(0)).alias("brands_processed"),
        F.sum(F.when(F.col("status") == "failed", 1).otherwise(0)).alias("brands_failed"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.col("brandId").cast("string")))), ",")
        .alias("failed_list"),
        F.round((F.max(F.unix_micros("ts")) - F.min(F.unix_micros("started"))) / 60e6, 2).alias("minutes"))
    cid = F.col("cluster_id")
    prods = detailed.groupBy("batch_number").agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_distinct(F.when(cid != -1, F.struct(F.col("brandId"), cid))).alias("total_clusters"),
        F.sum(F.when(cid != -1, 1).otherwise(0)).alias("products_clustered"))
    out = brands.join(prods, "batch_number", "left").na.fill(0, ["total_products", "total_clusters",
                                                                 "products_clustered"])
    return out.withColumn("clustering_rate", F.when(
        F.col("total_products") > 0, F.round(F.col("products_clustered") * 100.0 / F.col("total_products"), 6))
        .otherwise(F.lit(0.0)))


def global_summary(batches: DataFrame) -> DataFrame:
    """Totals across batches, and ``breakdown``, products and clusters batch by
    batch (``number:products:clusters``)."""
    each = F.array_sort(F.collect_list(F.struct("batch_number", "total_products", "total_clusters")))
    return batches.agg(
        F.array_join(F.transform(each, lambda b: F.concat_ws(":", *[b[c].cast("string") for c in (
            "batch_number", "total_products", "total_clusters")])), ",").alias("breakdown"),
        F.round(F.sum("minutes"), 2).alias("minutes"),
        F.count(F.lit(1)).alias("batches"),
        F.sum("brands_processed").alias("brands_processed"),
        F.sum("brands_failed").alias("brands_failed"),
        F.sum("total_products").alias("total_products"),
        F.sum("total_clusters").alias("total_clusters"),
        F.sum("products_clustered").alias("products_clustered")).withColumn(
        "clustering_rate", F.when(F.col("total_products") > 0, F.round(
            F.col("products_clustered") * 100.0 / F.col("total_products"), 6)).otherwise(F.lit(0.0)))
