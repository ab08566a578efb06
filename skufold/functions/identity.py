"""Identity strings (F7-F12) and the embedding input cleanup (V2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import phonetic
from . import pyregex as rx

# Fixed value (must equal the reference): identity for blank input.
UNKNOWN = "unknown product"
SEP = " | "


def _finish(identity: Column) -> Column:
    """Lower + strip; blank -> 'unknown product' (F12)."""
    out = rx.strip(F.lower(identity))
    return F.when(F.coalesce(out, F.lit("")) == "", F.lit(UNKNOWN)).otherwise(out)


def _nonblank(c: Column) -> Column:
    s = rx.strip(c)
    return F.when(s != "", s)


def with_phonetic(identity: Column, source: Column, algorithm: str | None) -> Column:
    """append ' | PHONETIC:<codes>' when codes exist."""
    if not algorithm:
        return identity
    codes = phonetic.encode(source, algorithm)
    return F.when((identity != "") & (codes != ""),
                  F.concat(identity, F.lit(" | PHONETIC:"), codes)).otherwise(identity)


def core_identity(name: Column, primary: Column, phonetic_algo: str | None = None) -> Column:
    """'name | primary category', blank parts dropped, lowered."""
    ident = F.concat_ws(SEP, _nonblank(name), _nonblank(primary))
    return _finish(with_phonetic(ident, ident, phonetic_algo))


def add_core_identity(df: DataFrame, name: Column, primary: Column, out: str,
                      phonetic_algo: str | None = None) -> DataFrame:
    """F7 as successive projections, so that no strip or case step is copied into the next."""
    d = df.withColumns({"_in": rx.strip(name), "_ip": rx.strip(primary)})
    parts = [F.when(F.col(c) != "", F.col(c)) for c in ("_in", "_ip")]
    d = d.withColumn("_ic", F.concat_ws(SEP, *parts))
    d = d.withColumn("_il", rx.strip(F.lower(with_phonetic(F.col("_ic"), F.col("_ic"), phonetic_algo))))
    d = d.withColumn(out, F.when(F.coalesce(F.col("_il"), F.lit("")) == "", F.lit(UNKNOWN)).otherwise(F.col("_il")))
    return d.drop("_in", "_ip", "_ic", "_il")


def simple_identity(brand: Column, primary: Column, phonetic_algo: str | None = None) -> Column:
    """F8: 'brand | primary category'."""
    return core_identity(brand, primary, phonetic_algo)


def facets_identity(raw: Column, phonetic_algo: str | None = None) -> Column:
    """F6 + F9: the phonetic text drops 'key:' prefixes and '|' first."""
    text = F.regexp_replace(F.regexp_replace(raw, f"{rx.WORD}+:", ""), r"\|", " ")
    return _finish(with_phonetic(raw, text, phonetic_algo))


def fallback_identity(name: Column, category: Column, facets_mode: bool) -> Column:
    """the row-error identity, not lowered; nulls print as Python's None."""
    n = F.coalesce(name, F.lit("None"))
    c = F.coalesce(category, F.lit("None"))
    if facets_mode:
        return F.concat(F.lit("product:"), n, F.lit(" | category:"), c)
    return F.concat(n, F.lit(SEP), c)


def clean_identity(identity: Column) -> Column:
    """V2: strip; blank or null -> 'unknown product'."""
    s = rx.strip(identity)
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(UNKNOWN)).otherwise(s)
