"""Catalog tables.

The engine reads five tables: ``sku`` (brandSKUId, brandId, label,
facets_jsonb, isActive), ``brand`` (brandId, brandLabel, isActive, isVerified,
isTest), ``category`` (categoryId, categoryLabel, isActive), ``sku_category``
(brandSKUId, categoryId) and ``seller_brand`` (sellerId, brandId).

``load_catalog`` reads them from parquet folders or from a JDBC source.
``derive_catalog`` builds them from the TPC-H-style test tables (``part`` and
``lineitem``) with Spark expressions, so every query grows with those tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Catalog:
    sku: DataFrame
    brand: DataFrame
    category: DataFrame
    sku_category: DataFrame
    seller_brand: DataFrame


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def derive_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Catalog views over ``part`` + ``lineitem`` (see FIXTURES.md section 2)."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    size_s = F.col("p_size").cast("string")
    suffix = (F.when(F.col("p_partkey") % 4 == 0, "g").when(F.col("p_partkey") % 4 == 1, " Grams")
              .when(F.col("p_partkey") % 4 == 2, "ml").otherwise(" (box)"))
    name_words = F.split(F.col("p_name"), " ")
    sku = part.select(
        F.col("p_partkey").alias("brandSKUId"),
        F.col("p_brand").alias("brandId"),
        F.concat(F.col("p_brand"), F.lit(" "), F.col("p_name"), F.lit(" "), size_s, suffix).alias("label"),
        F.concat(F.lit('{"flavour":"'), F.coalesce(F.element_at(name_words, 1), F.lit("")),
                 F.lit('","netWeight":"'), size_s,
                 F.lit('g","tags":["'), F.coalesce(F.element_at(name_words, 2), F.lit("")),
                 F.lit('",""],"brandName":"'), F.col("p_brand"), F.lit('"}')).alias("facets_jsonb"),
        (F.col("p_partkey") % 10 != 0).alias("isActive"))
    brand = part.select(
        F.col("p_brand").alias("brandId"), F.col("p_brand").alias("brandLabel"),
        (F.col("p_brand") != "Brand#7").alias("isActive"),
        (~F.col("p_brand").isin("Brand#3", "Brand#9")).alias("isVerified"),
        F.when(F.col("p_brand") == "Brand#5", True).when(F.col("p_brand") == "Brand#6", False)
        .cast("boolean").alias("isTest")).distinct()
    category = part.select(
        F.col("p_type").alias("categoryId"),
        F.when(F.col("p_type") == "SMALL", "Sweets/Snacks").when(F.col("p_type") == "PROMO", "N/A")
        .otherwise(F.col("p_type")).alias("categoryLabel"),
        (F.col("p_type") != "LARGE").alias("isActive")).distinct()
    sku_category = (part.select(F.col("p_partkey").alias("brandSKUId"), F.col("p_type").alias("categoryId"))
                    .union(part.select("p_partkey", F.when(F.col("p_size") > 25, "STANDARD")
                                       .otherwise("ECONOMY")))
                    .distinct())
    lineitem = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    seller_brand = (lineitem.join(part.select("p_partkey", "p_brand").filter(F.col("p_brand") != "Brand#11"),
                                  F.col("l_partkey") == F.col("p_partkey"))
                    .select(F.col("l_suppkey").alias("sellerId"), F.col("p_brand").alias("brandId"))
                    .distinct())
    return Catalog(sku, brand, category, sku_category, seller_brand)


def load_catalog(spark: SparkSession, base: str, fmt: str = "parquet") -> Catalog:
    """Read the five catalog tables from ``base/<name>`` in any Spark format."""
    def rd(name: str) -> DataFrame:
        return spark.read.format(fmt).load(f"{base.rstrip('/')}/{name}")
    return Catalog(rd("sku"), rd("brand"), rd("category"), rd("sku_category"), rd("seller_brand"))


def register_views(cat: Catalog, prefix: str = "") -> None:
    for name in ("sku", "brand", "category", "sku_category", "seller_brand"):
        getattr(cat, name).createOrReplaceTempView(prefix + name)
