"""Results (O1-O16): nesting, summaries, ranking, variant types, representatives.

Every aggregate is keyed by brand or by (brand, cluster) and combines map-side.
Windows are only ever partitioned by a cluster (bounded by the clustering
route), never by a brand or globally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pyregex as rx

GROUP, KEY = "brandId", "brandSKUId"
# Fixed values (must equal the reference): the noise bucket and cluster names.
NOISE_NAME = "no_sisters"
CLUSTER_PREFIX = "cluster_"
PRODUCT_FIELDS = ["brandSKUId", "label", "normalized_name", "core_identity", "categoryLabel",
                  "categories_parsed", "primary_category"]
# Variant type names (README), in display order.
VARIANT_TYPES = ["type_variant", "size_variant", "mixed", "single_product", "no_sisters"]
CHUNK = 10_000


def assign_clusters(processed: DataFrame, assignment: DataFrame) -> DataFrame:
    """O1: attach cluster_id (SKUs without an assignment are noise)."""
    return (processed.join(assignment.select(GROUP, KEY, "cluster_id"), [GROUP, KEY], "left")
            .withColumn("cluster_id", F.coalesce(F.col("cluster_id"), F.lit(-1)).cast("int")))


def cluster_name(cid=None):
    """O3: -1 -> 'no_sisters', else 'cluster_<id>'."""
    c = F.col("cluster_id") if cid is None else cid
    return F.when(c == -1, F.lit(NOISE_NAME)).otherwise(F.concat(F.lit(CLUSTER_PREFIX), c.cast("string")))


def nest_clusters(detailed: DataFrame) -> DataFrame:
    """O2: one row per (brand, cluster name, chunk) with its products array.

    Large clusters are split into chunks of at most CHUNK products (by hash),
    so no row or task ever holds an unbounded group; a brand's document is the
    set of its rows (see ``sinks.write_brand_json``).
    """
    sizes = detailed.groupBy(GROUP, "cluster_id").agg(F.count(F.lit(1)).alias("_n"))
    d = detailed.join(sizes, [GROUP, "cluster_id"])
    n_chunks = F.greatest(F.lit(1), F.ceil(F.col("_n") / CHUNK))
    d = d.withColumn("chunk", F.pmod(F.xxhash64(F.col(KEY).cast("string")), n_chunks).cast("int"))
    return (d.groupBy(GROUP, "cluster_id", "chunk")
            .agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in PRODUCT_FIELDS]))).alias("products"))
            .withColumn("cluster_name", cluster_name())
            .select(GROUP, "cluster_name", "cluster_id", "chunk", "products"))


def brand_summary(detailed: DataFrame, model: str = "", min_cluster_size: int = 2,
                  min_samples: int = 1, brand_label: str = "brandLabel") -> DataFrame:
    """Per brand total / clusters / with / without + metadata."""
    cid = F.col("cluster_id")
    return (detailed.groupBy(GROUP).agg(
        F.first(brand_label, ignorenulls=True).alias("brand"),
        F.count(F.lit(1)).alias("total_products"),
        F.count_distinct(F.when(cid != -1, cid)).alias("total_clusters"),
        F.sum(F.when(cid != -1, 1).otherwise(0)).alias("products_with_sisters"),
        F.sum(F.when(cid == -1, 1).otherwise(0)).alias("products_without_sisters"))
        .withColumn("processing_metadata", F.struct(
            F.lit(model).alias("model_used"), F.lit(min_cluster_size).alias("min_cluster_size"),
            F.lit(min_samples).alias("min_samples"), F.current_timestamp().alias("timestamp"))))


def brand_document(detailed: DataFrame, **options) -> DataFrame:
    """O4 + O12: a brand's counts, metadata and ``variant_type_summary``."""
    kinds = variant_type_summary(detailed).select(
        GROUP, F.struct(*VARIANT_TYPES).alias("variant_type_summary"))
    return brand_summary(detailed, **options).join(kinds, GROUP, "left")


def cluster_summary(detailed: DataFrame) -> DataFrame:
    """Flat rows with the cluster name."""
    return detailed.select(GROUP, cluster_name().alias("cluster_id"), KEY, "label", "normalized_name",
                           "categoryLabel", "categories_parsed", "primary_category")


def cluster_sizes(detailed: DataFrame) -> DataFrame:
    return (detailed.filter(F.col("cluster_id") != -1)
            .groupBy(GROUP, "cluster_id").agg(F.count(F.lit(1)).alias("size")))


def top_clusters(detailed: DataFrame, k: int = 5, sample: int = 3) -> DataFrame:
    """Per brand the k largest clusters (noise excluded; ties by id), with
    the first ``sample`` labels (by SKU id) and the 'and N more' count."""
    sizes = cluster_sizes(detailed)
    ranked = sizes.withColumn("rank", F.row_number().over(
        Window.partitionBy(GROUP).orderBy(F.desc("size"), "cluster_id")))
    top = ranked.filter(F.col("rank") <= k)
    members = detailed.join(top.select(GROUP, "cluster_id"), [GROUP, "cluster_id"], "left_semi")
    firsts = (members.withColumn("_i", F.row_number().over(
        Window.partitionBy(GROUP, "cluster_id").orderBy(KEY)))
        .filter(F.col("_i") <= sample)
        .groupBy(GROUP, "cluster_id")
        .agg(F.array_sort(F.collect_list(F.struct("_i", "label"))).alias("_s")))
    return (top.join(firsts, [GROUP, "cluster_id"])
            .select(GROUP, "rank", cluster_name().alias("cluster_name"), "size",
                    F.transform("_s", lambda x: x["label"]).alias("sample_labels"),
                    F.greatest(F.col("size") - sample, F.lit(0)).alias("more")))


def master_summary(detailed: DataFrame) -> DataFrame:
    """Global totals. total_clusters counts (brand, cluster) pairs; the
    reference's raw figure (distinct ids) is kept as distinct_cluster_ids."""
    cid = F.col("cluster_id")
    with_s = F.sum(F.when(cid != -1, 1).otherwise(0))
    return detailed.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_distinct(GROUP).alias("total_brands"),
        F.count_distinct(F.when(cid != -1, F.struct(F.col(GROUP), cid))).alias("total_clusters"),
        F.count_distinct(F.when(cid != -1, cid)).alias("distinct_cluster_ids"),
        with_s.alias("products_with_sisters"),
        F.round(with_s * 100.0 / F.count(F.lit(1)), 6).alias("clustering_rate"))


def run_summary(detailed: DataFrame) -> DataFrame:
    """Per brand and grand total (brandId null) with a zero-safe rate."""
    cid = F.col("cluster_id")
    agg = detailed.rollup(GROUP).agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_distinct(F.when(cid != -1, F.struct(F.col(GROUP), cid))).alias("total_clusters"),
        F.sum(F.when(cid != -1, 1).otherwise(0)).alias("products_with_sisters"))
    return agg.withColumn("clustering_rate", F.when(
        F.col("total_products") > 0,
        F.round(F.col("products_with_sisters") * 100.0 / F.col("total_products"), 6)).otherwise(F.lit(0.0)))


def number_signature(label):
    """O11 helper: sorted distinct numbers in a label (``200g.`` = ``200 Grams``)."""
    nums = F.regexp_extract_all(label, F.lit(f"{rx.DIGIT}+(?:\\.{rx.DIGIT}+)?"), 0)
    return F.array_join(F.array_sort(F.array_distinct(nums)), ",")


def variant_type(detailed: DataFrame) -> DataFrame:
    """Per cluster: n SKUs, d distinct number signatures ->
    noise: no_sisters; n = 1: single_product; d = 1: type_variant;
    d = n: size_variant; else mixed."""
    sig = detailed.withColumn("_sig", number_signature(F.col("label")))
    g = sig.groupBy(GROUP, "cluster_id").agg(F.count(F.lit(1)).alias("n_products"),
                                             F.count_distinct("_sig").alias("n_signatures"))
    n, d = F.col("n_products"), F.col("n_signatures")
    vt = (F.when(F.col("cluster_id") == -1, "no_sisters").when(n == 1, "single_product")
          .when(d == 1, "type_variant").when(d == n, "size_variant").otherwise("mixed"))
    return g.withColumn("variant_type", vt).withColumn("cluster_name", cluster_name())


def variant_type_summary(detailed: DataFrame) -> DataFrame:
    """Per brand counts of each variant type."""
    vt = variant_type(detailed)
    return (vt.groupBy(GROUP).pivot("variant_type", VARIANT_TYPES).agg(F.count(F.lit(1)))
            .na.fill(0, VARIANT_TYPES))


def representatives(rows: DataFrame) -> DataFrame:
    """Drop noise, rename cluster_id -> clusterId, sisterProductId = the
    smallest SKU id of (brandId, clusterId) (deterministic rule in place of
    file order). An aggregate + join, so no window over a cluster."""
    r = (rows.select(GROUP, F.col("cluster_id").cast("int").alias("clusterId"), KEY)
         .filter(F.col("clusterId") >= 0))
    rep = r.groupBy(GROUP, "clusterId").agg(F.min(KEY).alias("sisterProductId"))
    return r.join(rep, [GROUP, "clusterId"]).select(GROUP, "clusterId", KEY, "sisterProductId")


def validate_representatives(master: DataFrame) -> DataFrame:
    """Groups with more than one representative (empty = valid)."""
    return (master.groupBy(GROUP, "clusterId").agg(F.count_distinct("sisterProductId").alias("n_representatives"))
            .filter(F.col("n_representatives") > 1))


def master_stats(master: DataFrame) -> DataFrame:
    """Rows, unique brands / clusters / products."""
    return master.agg(F.count(F.lit(1)).alias("total_rows"),
                      F.count_distinct(GROUP).alias("unique_brands"),
                      F.count_distinct("clusterId").alias("unique_cluster_ids"),
                      F.count_distinct(GROUP, "clusterId").alias("unique_clusters"),
                      F.count_distinct(KEY).alias("unique_products"))


def preview(master: DataFrame, n: int = 10) -> DataFrame:
    """First rows in key order (a top-n report)."""
    return master.orderBy(GROUP, "clusterId", KEY).limit(n)
