"""Label normalization N1-N13 as Spark column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pyregex as rx
from .pyregex import py

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference), written in Python regex syntax and
# rewritten for Java by ``py``.
# Unit words that, after the last number, cut the label there.
UNIT_WORDS = [r"grams?", r"gms?", r"g", r"kg", r"kilograms?", r"kilo",
              r"ml", r"milliliters?", r"liters?", r"l", r"ltrs?",
              r"oz", r"ounces?", r"lbs?", r"pounds?", r"gram", r"gm"]
# Trailing number + unit.
TRAILING_MEASURE = r"\s+\d+\s*(g|gm|gms|gram|grams|kg|ml|l|ltr|ltrs|liter|liters|oz|lb|lbs|pound|pounds)\s*$"
# Trailing packaging word, with and without parentheses.
TRAILING_PACK = [r"\s+\((box|pack|packet|pouch|bag|tin|can|jar|bottle)\)\s*$",
                 r"\s+(box|pack|packet|pouch|bag|tin|can|jar|bottle)\s*$"]
# Dashes.
DASHES = r"\s*[-–—]\s*"
# Variant patterns, in order (weight, volume, size, price, packet size).
VARIANT_PATTERNS = [
    r"\b\d+(\.\d+)?\s*(grams?|g|kg|kilograms?|ounces?|oz|lbs?|pounds?)\b",
    r"\b\d+(\.\d+)?\s*gm\b",
    r"\b\d+(\.\d+)?\s*GM\b",
    r"\b\d+(\.\d+)?\s*(ml|milliliters?|liters?|l|fl\.?\s*oz|fluid\s*ounces?)\b",
    r"\b\d+(\.\d+)?\s*ML\b",
    r"\b(small|medium|large|xl|xxl|s|m|l)\b",
    r"\b\d+\s*(inch|inches|cm|centimeters?|mm|millimeters?)\b",
    r"rs\.?\s*\d+",
    r"₹\s*\d+",
    r"\$\s*\d+(\.\d+)?",
    r"\b(single-use|multi-use|family\s*pack|party\s*pack)\b",
]
# Lone numbers.
LONE_NUMBER = r"\b\d+\b"
# Noise patterns.
NOISE_PATTERNS = [
    r"\b(rs\.?|₹)\s*\d+\b",
    r"\b\d+%\s*(extra|off|free)\b",
    r"\b(new|improved|special|premium|original)\b",
    r"\b(available|now|today|limited|offer)\b",
]
MIN_LENGTH = 3
# ---------------------------------------------------------------------------

# Passes that run. When N8 starts, N7 has left only word characters and spaces,
# so patterns that need one of ₹ $ % cannot match; letter case is ignored, so GM
# and ML repeat gm and ml; N9 leaves no number for N10's price. N10's word lists
# are one alternation, as each match becomes a space of its own.
_N8 = [p for p in VARIANT_PATTERNS if not any(x in p for x in ("GM", "ML", "₹", r"\$"))]
_N10 = "|".join(p for p in NOISE_PATTERNS if not any(x in p for x in ("₹", "%")))

_UNIT_WORD_RE = "^(?:" + "|".join(UNIT_WORDS) + ")$"


def trailing_measure_cut(label: Column) -> Column:
    """N1 as one expression (for single-column use); ``add_normalized_name``
    runs the same rule in stages."""
    t = rx.strip(label)
    words = rx.split_words(t)
    return _cut(t, words, _last_number(words))


def _last_number(words: Column) -> Column:
    return F.array_max(F.filter(
        F.transform(words, lambda w, i: F.when(w.rlike(rx.DIGIT), i).otherwise(F.lit(-1))),
        lambda i: i >= 0))


def _cut(t: Column, words: Column, last_num: Column) -> Column:
    """Cut at the last word holding a digit when a unit word follows it."""
    rest = F.slice(words, last_num + 2, F.size(words) + 1)
    unit_follows = F.exists(rest, lambda w: F.regexp_replace(F.lower(w), rx.NONWORD, "").rlike(_UNIT_WORD_RE))
    return F.when((last_num > 0) & unit_follows,
                  F.array_join(F.slice(words, F.lit(1), last_num), " ")).otherwise(t)


def remove_size_values(name: Column, values: Column) -> Column:
    """Remove facet size values (and their long words) from the name."""
    def per_value(acc, v):
        words = rx.split_words(rx.strip(v))
        long_words = F.when(F.size(words) > 1, F.filter(words, lambda w: F.length(w) > 3)) \
            .otherwise(F.array().cast("array<string>"))
        return F.aggregate(long_words, F.replace(acc, v, F.lit(" ")),
                           lambda a, w: F.regexp_replace(
                               a, F.concat(F.lit(rx.BOUNDARY), rx.quote(w), F.lit(rx.BOUNDARY)), F.lit(" ")))
    return F.aggregate(values, name, per_value)


def strip_brand_prefix(name: Column, brand: Column, need_space: bool = False) -> Column:
    """N6 (need_space=False: any prefix, even inside a word) and the N12 form."""
    bc = rx.strip(F.lower(brand))
    prefix = F.concat(bc, F.lit(" ")) if need_space else bc
    hit = (F.coalesce(bc, F.lit("")) != "") & name.startswith(prefix)
    return F.when(hit, rx.strip(name.substr(F.length(bc) + 1, F.lit(1 << 30)))).otherwise(name)


def _middle(n: Column) -> Column:
    """A straight chain (each step uses the previous once)."""
    n = F.regexp_replace(n, py(DASHES), " ")                                 # N7
    n = F.regexp_replace(n, rx.SPECIAL, " ")
    for p in _N8:                                                            # N8
        n = F.regexp_replace(n, py(p, True), " ")
    n = F.regexp_replace(n, py(LONE_NUMBER), " ")                            # N9
    n = F.regexp_replace(n, py(_N10, True), " ")                             # N10
    return rx.squeeze(n)                                                     # N11


def _head(n1: Column) -> Column:
    """N2-N4."""
    n = F.regexp_replace(n1, py(TRAILING_MEASURE, True), "")                 # N2
    for p in TRAILING_PACK:                                                  # N3
        n = F.regexp_replace(n, py(p, True), "")
    return rx.strip(F.lower(n))                                              # N4


def add_normalized_name(df: DataFrame, label: str, size_vals: str, brand: str,
                        out: str = "normalized_name") -> DataFrame:
    """N1..N12 in order, as successive projections.

    Every step reads the previous step's column, so no step's expression is
    copied into the next (a single nested expression would repeat N1-N5
    several times through N6 and N12).
    """
    lab, br = F.col(label), F.col(brand)
    d = df.withColumn("_nt", rx.strip(lab))
    d = d.withColumn("_nw", rx.split_words(F.col("_nt")))
    d = d.withColumn("_ni", _last_number(F.col("_nw")))
    d = d.withColumn("_n1", _cut(F.col("_nt"), F.col("_nw"), F.col("_ni")))
    d = d.withColumn("_n4", _head(F.col("_n1")))
    d = d.withColumn("_n5", remove_size_values(F.col("_n4"), F.col(size_vals)))
    d = d.withColumn("_n6", strip_brand_prefix(F.col("_n5"), br))
    d = d.withColumn("_n11", _middle(F.col("_n6")))
    # The fallback's regexes run for the few names that need it.
    short = F.length(F.col("_n11")) < MIN_LENGTH
    d = d.withColumn("_nfb", F.when(short, rx.squeeze(F.regexp_replace(F.lower(lab), rx.SPECIAL, " "))))
    d = d.withColumn(out, F.when(lab.isNull(), F.lit(None).cast("string"))
                     .when(short,
                           strip_brand_prefix(F.col("_nfb"), br, need_space=True))
                     .otherwise(F.col("_n11")))
    return d.drop("_nt", "_nw", "_ni", "_n1", "_n4", "_n5", "_n6", "_n11", "_nfb")


def normalize_name(label: Column, size_vals: Column, brand: Column) -> Column:
    """N13 as a single column expression (small inputs and tests only; the
    pipeline uses ``add_normalized_name``)."""
    t = rx.strip(label)
    words = rx.split_words(t)
    n = _head(trailing_measure_cut(label))
    n = strip_brand_prefix(remove_size_values(n, size_vals), brand)
    n = _middle(n)
    fb = strip_brand_prefix(rx.squeeze(F.regexp_replace(F.lower(label), rx.SPECIAL, " ")), brand, need_space=True)
    return F.when(F.length(n) < MIN_LENGTH, fb).otherwise(n)
