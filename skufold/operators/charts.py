"""Chart tables (G1-G10): the data behind the reference's charts, as
DataFrames. Drawing is left to any plotting tool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .results import GROUP, KEY, cluster_name, cluster_sizes

DEFAULT_BINS = 10


def cluster_size_histogram(detailed: DataFrame, bins: int | None = None) -> DataFrame:
    """G1: per brand, histogram of cluster sizes (noise excluded).
    bins = max(10, clusters // 5) unless given; equal-width bins over
    [min, max] like numpy (the top edge falls in the last bin)."""
    sizes = cluster_sizes(detailed)
    st = sizes.groupBy(GROUP).agg(F.min("size").alias("lo"), F.max("size").alias("hi"),
                                  F.count(F.lit(1)).alias("nc"))
    nb = F.lit(bins) if bins else F.greatest(F.lit(DEFAULT_BINS), F.floor(F.col("nc") / 5))
    s = sizes.join(st, GROUP).withColumn("bins", nb.cast("int"))
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("size") - F.col("lo")) * F.col("bins") / (F.col("hi") - F.col("lo"))),
                F.col("bins") - 1)).cast("int")
    return (s.withColumn("bin", b).groupBy(GROUP, "bin", "bins", "lo", "hi")
            .agg(F.count(F.lit(1)).alias("n_clusters")))


def largest_clusters(detailed: DataFrame, k: int = 10) -> DataFrame:
    """Per brand top k clusters by size (ties by id)."""
    sizes = cluster_sizes(detailed)
    r = sizes.withColumn("rank", F.row_number().over(Window.partitionBy(GROUP).orderBy(F.desc("size"), "cluster_id")))
    return r.filter(F.col("rank") <= k).withColumn("cluster_name", cluster_name())


def clustered_split(detailed: DataFrame) -> DataFrame:
    """With / without sisters per brand."""
    cid = F.col("cluster_id")
    return detailed.groupBy(GROUP).agg(
        F.sum(F.when(cid != -1, 1).otherwise(0)).alias("with_sisters"),
        F.sum(F.when(cid == -1, 1).otherwise(0)).alias("without_sisters"))


def cluster_size_stats(detailed: DataFrame) -> DataFrame:
    """Avg / max / min cluster size per brand over all clusters (0 if none)."""
    brands = detailed.select(GROUP).distinct()
    st = cluster_sizes(detailed).groupBy(GROUP).agg(
        F.avg("size").alias("avg_size"), F.max("size").alias("max_size"), F.min("size").alias("min_size"))
    return brands.join(st, GROUP, "left").select(
        GROUP, F.round(F.coalesce("avg_size", F.lit(0.0)), 6).alias("avg_size"),
        F.coalesce("max_size", F.lit(0)).alias("max_size"), F.coalesce("min_size", F.lit(0)).alias("min_size"))


def _category(df: DataFrame):
    return F.coalesce(F.col("primary_category"), F.col("categoryLabel"))


def products_per_category(detailed: DataFrame) -> DataFrame:
    """Clustered SKUs per category (primary, else the raw label)."""
    return (detailed.filter(F.col("cluster_id") != -1)
            .groupBy(GROUP, _category(detailed).alias("category")).agg(F.count(F.lit(1)).alias("n_products")))


def clusters_per_category(detailed: DataFrame) -> DataFrame:
    """Distinct clusters per category."""
    return (detailed.filter(F.col("cluster_id") != -1)
            .groupBy(GROUP, _category(detailed).alias("category"))
            .agg(F.count_distinct("cluster_id").alias("n_clusters")))


def graph_nodes(detailed: DataFrame, width: int = 20) -> DataFrame:
    """One node per clustered SKU; label cut to ``width`` chars + '...'."""
    lab = F.col("label")
    short = F.when(F.length(lab) > width, F.concat(F.substring(lab, 1, width), F.lit("..."))).otherwise(lab)
    return (detailed.filter(F.col("cluster_id") != -1)
            .select(GROUP, F.col(KEY).alias("id"), short.alias("short_label"), "label", "normalized_name",
                    _category(detailed).alias("category"),
                    F.coalesce("categories_parsed", "categoryLabel").alias("categories_all"),
                    cluster_name().alias("cluster")))


def graph_edges(detailed: DataFrame) -> DataFrame:
    """Cluster edges as a star around the cluster's smallest SKU id.

    The reference draws every pair inside a cluster; a star has the same
    connected components with n - 1 edges instead of n(n-1)/2, so a large
    cluster never fans out quadratically.
    """
    members = detailed.filter(F.col("cluster_id") != -1).select(GROUP, "cluster_id", KEY)
    hub = members.groupBy(GROUP, "cluster_id").agg(F.min(KEY).alias("source"))
    return (members.join(hub, [GROUP, "cluster_id"]).filter(F.col(KEY) != F.col("source"))
            .select(GROUP, "source", F.col(KEY).alias("target"), cluster_name().alias("cluster")))


def cluster_details(detailed: DataFrame, k: int = 6, width: int = 30) -> DataFrame:
    """The k largest clusters with >= 2 SKUs, an ordinal per SKU, label cut."""
    sizes = cluster_sizes(detailed).filter(F.col("size") >= 2)
    top = (sizes.withColumn("rank", F.row_number().over(
        Window.partitionBy(GROUP).orderBy(F.desc("size"), "cluster_id"))).filter(F.col("rank") <= k))
    m = detailed.join(top, [GROUP, "cluster_id"])
    lab = F.col("label")
    return m.select(GROUP, "rank", cluster_name().alias("cluster_name"), "size", KEY,
                    (F.row_number().over(Window.partitionBy(GROUP, "cluster_id").orderBy(KEY)) - 1).alias("ordinal"),
                    F.when(F.length(lab) > width, F.concat(F.substring(lab, 1, width), F.lit("...")))
                    .otherwise(lab).alias("short_label"))


def brand_comparison(detailed: DataFrame) -> DataFrame:
    """Per brand products, clusters, with sisters, rate; rows only when
    at least two brands are present (a scalar count decides)."""
    cid = F.col("cluster_id")
    per = detailed.groupBy(GROUP).agg(
        F.count(F.lit(1)).alias("products"),
        F.count_distinct(F.when(cid != -1, cid)).alias("clusters"),
        F.sum(F.when(cid != -1, 1).otherwise(0)).alias("with_sisters"))
    per = per.withColumn("rate", F.round(F.col("with_sisters") * 100.0 / F.col("products"), 6))
    n_brands = per.count()
    return per if n_brands >= 2 else per.limit(0)
