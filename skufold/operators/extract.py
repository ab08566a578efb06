"""Extraction (R1-R13): one active row per SKU with brand and one category.

Shape of the plan: the SKU table is the only large input. ``brand`` and
``category`` are dimension tables (one row per brand / category); they are
broadcast when the planner finds them small, otherwise joined
by shuffle. The seller link is a semi-join (it only proves existence, so it
never multiplies rows), exclusions are anti-joins, and the one-category pick is
an aggregate (``min_by``) that combines map-side instead of a window sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import Catalog

EXTRACT_COLUMNS = ["brandSKUId", "brandId", "brandLabel", "label", "facets_jsonb", "categoryLabel"]


def active_brands(brand: DataFrame, exclude_test: bool = False, verified_only: bool = False) -> DataFrame:
    """R2 on brands, plus R9 (test brands) and R13 (verified) when asked."""
    b = brand.filter(F.col("isActive"))
    if exclude_test:
        b = exclude_test_brands(b)
    if verified_only:
        b = b.filter(F.coalesce(F.col("isVerified"), F.lit(False)))
    return b


def exclude_test_brands(brand: DataFrame) -> DataFrame:
    """``isTest = false OR isTest IS NULL``."""
    return brand.filter(~F.coalesce(F.col("isTest"), F.lit(False)))


def linked_brands_only(df: DataFrame, seller_brand: DataFrame) -> DataFrame:
    """Keep brands with a seller link; a semi-join never duplicates rows."""
    return df.join(seller_brand.select("brandId").distinct(), "brandId", "left_semi")


def exclude_ids(df: DataFrame, ids: DataFrame | None, col: str = "brandId") -> DataFrame:
    """Drop listed ids with a null-safe anti-join (no IN-list text)."""
    if ids is None:
        return df
    key = ids.columns[0]
    ids = ids.select(F.col(key).cast("string").alias("_xid")).filter(F.col("_xid").isNotNull())
    return df.join(ids.distinct(),
                   F.col(col).cast("string") == F.col("_xid"), "left_anti")


def filter_brands(df: DataFrame, brand_ids: DataFrame | str | list | None) -> DataFrame:
    """One id, a list of ids, or an id DataFrame (semi-join)."""
    if brand_ids is None:
        return df
    if isinstance(brand_ids, str):
        return df.filter(F.col("brandId") == brand_ids)
    if isinstance(brand_ids, (list, tuple)):
        return df.filter(F.col("brandId").isin(*brand_ids))
    key = brand_ids.columns[0]
    return df.join(brand_ids.select(F.col(key).alias("brandId")).distinct(), "brandId", "left_semi")


def one_category_per_product(bridge: DataFrame, order: str = "categoryId", seed: int = 0) -> DataFrame:
    """One ``categoryId`` per SKU, picked on the thin bridge table.

    Default: the smallest ``categoryId`` (deterministic, so re-runs and oracles
    agree). ``order="random"`` reproduces the reference's random pick with a
    seeded hash. An aggregate, so it combines map-side before the shuffle and
    the wide SKU rows are never sorted per SKU.
    """
    if order == "categoryId":
        agg = F.min("categoryId")
    else:
        agg = F.min_by("categoryId", F.xxhash64("brandSKUId", "categoryId", F.lit(seed)))
    return bridge.groupBy("brandSKUId").agg(agg.alias("categoryId"))


def distinct_products(df: DataFrame) -> DataFrame:
    """Plain DISTINCT over all columns (facets still a JSON string)."""
    return df.distinct()


def catalog_extract(cat: Catalog, brand_ids=None, linked_only: bool = True,
                    exclude: DataFrame | None = None, exclude_test: bool = False,
                    verified_only: bool = False, facets_not_null: bool = False,
                    category_order: str = "categoryId") -> DataFrame:
    """The product input of the pipeline, one row per SKU."""
    brands = active_brands(cat.brand, exclude_test, verified_only).select("brandId", "brandLabel")
    brands = exclude_ids(brands, exclude)
    if linked_only:
        brands = linked_brands_only(brands, cat.seller_brand)
    brands = filter_brands(brands, brand_ids)
    cats = cat.category.filter(F.col("isActive")).select("categoryId", "categoryLabel")
    sku = cat.sku.filter(F.col("isActive")).select("brandSKUId", "brandId", "label", "facets_jsonb")
    if facets_not_null:
        sku = sku.filter(F.col("facets_jsonb").isNotNull())
    sku = filter_brands(sku, brand_ids)
    bridge = cat.sku_category.join(cats.select("categoryId"),
                                   "categoryId", "left_semi")
    picked = one_category_per_product(bridge, category_order)
    joined = (sku.join(brands, "brandId")
              .join(picked, "brandSKUId")
              .join(cats, "categoryId"))
    return joined.select(*EXTRACT_COLUMNS)


def brand_rollup(cat: Catalog, linked_only: bool = True, exclude: DataFrame | None = None,
                 exclude_test: bool = True) -> DataFrame:
    """Brands with at least one active SKU in an active category, with
    ``product_count`` = distinct SKUs; ordered by product_count desc, id."""
    brands = active_brands(cat.brand, exclude_test).select("brandId", F.col("brandLabel").alias("brandName"))
    brands = exclude_ids(brands, exclude)
    if linked_only:
        brands = linked_brands_only(brands, cat.seller_brand)
    sku = cat.sku.filter(F.col("isActive")).select("brandSKUId", "brandId")
    active_cat = cat.category.filter(F.col("isActive")).select("categoryId")
    sku_in_cat = (cat.sku_category.join(active_cat, "categoryId", "left_semi")
                  .select("brandSKUId"))
    counted = (sku.join(sku_in_cat, "brandSKUId", "left_semi")
               .join(brands, "brandId")
               .groupBy("brandId", "brandName").agg(F.count_distinct("brandSKUId").alias("product_count")))
    return counted.filter(F.col("product_count") > 0).orderBy(F.desc("product_count"), "brandId")


def verified_brands(cat: Catalog) -> DataFrame:
    """Active, verified, linked brands; name = coalesce(label, id)."""
    b = cat.brand.filter(F.col("isActive") & F.coalesce(F.col("isVerified"), F.lit(False)))
    b = linked_brands_only(b, cat.seller_brand)
    return (b.select("brandId", F.coalesce(F.col("brandLabel"), F.col("brandId").cast("string")).alias("brandLabel"))
            .distinct().orderBy("brandLabel", "brandId"))


def order_products(df: DataFrame) -> DataFrame:
    """Order by brand (only at sinks)."""
    return df.orderBy("brandId", "brandSKUId")
