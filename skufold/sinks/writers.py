"""Sinks (K1-K6, K8, K9; K7 is ``sources.jdbc.write_jdbc``).

Per-brand outputs are tables of a snapshot store: brands lie clustered in files of a
target size, an index names the files of a brand, and a write replaces the brands it
has, all at once. ``*_rows`` give a sink's rows; a run stages those of a batch
together (``plans.flows``), ``write_*`` commits one sink by itself and ``read_sink``
reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pyregex as rx
from ..operators import results as res
from .snapshots import SnapshotStore

ROWS = "rows"


def brand_clean(brand_col: str = "brandLabel") -> F.Column:
    """File-safe brand name: lower, ``[^\\w\\-_]`` -> ``_``."""
    return F.regexp_replace(F.lower(F.col(brand_col)), f"[^{rx.W}\\-_]", "_")


def _names(detailed: DataFrame, brand_col: str) -> DataFrame:
    return detailed.groupBy("brandId").agg(F.min(brand_clean(brand_col)).alias("brand_clean"))


def _stamped(detailed: DataFrame, brand_col: str) -> DataFrame:
    return (detailed.withColumn("brand_name", F.col(brand_col))
            .withColumn("processing_timestamp", F.current_timestamp()))


def brand_json_rows(detailed: DataFrame, brand_col: str = "brandLabel", **metadata) -> DataFrame:
    """K1: per brand a line per cluster chunk, with its variant type, and one line with
    the brand's document: counts, variant type summary and processing metadata
    (``metadata``: model, min_cluster_size, min_samples)."""
    kinds = res.variant_type(detailed).select("brandId", "cluster_id", "variant_type")
    nested = res.nest_clusters(detailed).join(kinds, ["brandId", "cluster_id"])
    whole = nested.unionByName(res.brand_document(detailed, brand_label=brand_col, **metadata), allowMissingColumns=True)
    return whole.join(_names(detailed, brand_col), "brandId")


def detailed_rows(detailed: DataFrame, brand_col: str = "brandLabel") -> DataFrame:
    """K2: all processed rows, for CSV."""
    return detailed.withColumn("brand_clean", brand_clean(brand_col))


def cluster_summary_rows(detailed: DataFrame, brand_col: str = "brandLabel") -> DataFrame:
    """K3: flat cluster summary, with each cluster's variant type, for CSV."""
    kinds = res.variant_type(detailed).select("brandId", F.col("cluster_name").alias("cluster_id"), "variant_type")
    return (res.cluster_summary(detailed).join(kinds, ["brandId", "cluster_id"])
            .join(_names(detailed, brand_col), "brandId"))


def master_rows(detailed: DataFrame, brand_col: str = "brandLabel") -> DataFrame:
    """K4 and K8: consolidated rows with brand_name and processing_timestamp."""
    return _stamped(detailed, brand_col)


def _write(rows: DataFrame, path: str, key: str, fmt: str) -> None:
    SnapshotStore(rows.sparkSession, path).replace(ROWS, rows, key, fmt=fmt)


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    """Current rows of a sink that a ``write_*`` function wrote."""
    return SnapshotStore(spark, path).read(ROWS)


def write_brand_json(detailed: DataFrame, path: str, brand_col: str = "brandLabel", **metadata) -> None:
    _write(brand_json_rows(detailed, brand_col, **metadata), path, "brandId", "json")


def write_detailed(detailed: DataFrame, path: str, brand_col: str = "brandLabel") -> None:
    _write(detailed_rows(detailed, brand_col), path, "brandId", "csv")


def write_cluster_summary(detailed: DataFrame, path: str, brand_col: str = "brandLabel") -> None:
    _write(cluster_summary_rows(detailed, brand_col), path, "brandId", "csv")


def write_master(detailed: DataFrame, path: str, brand_col: str = "brandLabel") -> None:
    """K4: a brand's rows are replaced on every write (B6 on disk)."""
    _write(master_rows(detailed, brand_col), path, "brandId", "parquet")


def write_master_summary(detailed: DataFrame, path: str) -> None:
    """K5: global statistics (one row)."""
    res.master_summary(detailed).withColumn("processing_timestamp", F.current_timestamp()) \
        .coalesce(1).write.mode("overwrite").json(path)


def write_combined_json(summary: DataFrame, path: str) -> None:
    """K6: all brand documents (counts, variant types, metadata) in one dataset."""
    summary.write.mode("overwrite").json(path)


def write_batch(detailed: DataFrame, path: str, brand_col: str = "brandLabel") -> None:
    """K8: batch results with brand_name, batch_number, processing_timestamp;
    only the batches present are replaced."""
    _write(master_rows(detailed, brand_col), path, "batch_number", "parquet")


def write_representatives(master: DataFrame, path: str) -> int:
    """K9: the 4-column master as CSV; an empty master is a failure."""
    n = master.limit(1).count()
    if n == 0:
        raise ValueError("no representative rows to write")
    master.select("brandId", "clusterId", "brandSKUId", "sisterProductId") \
        .write.mode("overwrite").option("header", True).csv(path)
    return n
