"""Row processing: one extract row -> processed row.

Everything is a column expression evaluated inside whole-stage codegen; no
Python runs per row unless a Python phonetic codec is chosen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import categories as cat
from ..functions import facets as fx
from ..functions import identity as idn
from ..functions.normalize import add_normalized_name
from .sizing import cpu_partitions


@dataclass(frozen=True)
class IdentityConfig:
    """How identity strings are built (reference CLI flags)."""
    use_facets: bool = False          # --use-facets
    simple_identity: bool = False     # --simple-identity
    phonetic: str | None = None       # None = off; else soundex|metaphone|nysiis|match_rating_codex


PROCESSED_COLUMNS = ["normalized_name", "core_identity", "brand_extracted",
                     "categories_parsed", "primary_category", "row_status"]


def dealt(df: DataFrame) -> DataFrame:
    """df's rows on all cores, for work that costs by the row and not by the byte."""
    return df if df.isStreaming else df.repartition(cpu_partitions(df.sparkSession))


def process_products(df: DataFrame, cfg: IdentityConfig = IdentityConfig(),
                     label: str = "label", facets: str = "facets_jsonb",
                     category: str = "categoryLabel", brand: str = "brandLabel") -> DataFrame:
    """Add normalized_name, core_identity, brand_extracted, categories_parsed,
    primary_category and row_status ('ok' | 'fallback') to each row.

    Rows are dealt to all cores first: their cost is regexes, not bytes, and partitions
    sized by bytes would leave the work to a few tasks."""
    lab, fac, catl, br = F.col(label), F.col(facets), F.col(category), F.col(brand)
    if facets not in df.columns:
        df = df.withColumn(facets, F.lit(None).cast("string"))
    staged = dealt(df).withColumns({"_fm": fx.text_map(fac), "_fv": fx.variant_map(fac),
                             "_cats": cat.parse_categories(catl)})
    staged = staged.withColumn("_fk", F.when(F.col("_fm").isNull() & fac.isNotNull(), fx.json_kind(fac)))
    fm, fv = F.col("_fm"), F.col("_fv")
    usable = fx.facets_usable(fm, F.col("_fk"), fac)
    has_facets = F.coalesce(F.size(fm) > 0, F.lit(False))
    staged = staged.withColumn("_ok", lab.isNotNull() & usable)
    staged = staged.withColumn("_size", F.when(F.col("_ok"), fx.size_values(fm, fv))
                               .otherwise(F.array().cast("array<string>")))
    staged = add_normalized_name(staged, label, "_size", brand)
    ok = F.col("_ok")
    name, cats = F.col("normalized_name"), F.col("_cats")
    primary = cat.primary_category(cats)
    brand_x = F.when(ok & has_facets, fx.brand_from_facets(fm, br)).otherwise(br)
    staged = idn.add_core_identity(staged, brand_x if cfg.simple_identity else name, primary, "_core", cfg.phonetic)
    core = F.col("_core")
    if cfg.use_facets:
        raw = fx.facets_identity_raw(fm, fv, catl, cats)
        core = F.when(has_facets, idn.facets_identity(raw, cfg.phonetic)).otherwise(core)
    core = F.when(ok, core).otherwise(idn.fallback_identity(name, catl, cfg.use_facets))
    out = staged.withColumns({
        "core_identity": core,
        "brand_extracted": brand_x,
        "categories_parsed": cat.categories_parsed(cats),
        "primary_category": primary,
        "row_status": F.when(ok, F.lit("ok")).otherwise(F.lit("fallback"))})
    return out.drop("_fm", "_fv", "_fk", "_cats", "_ok", "_size", "_core")
