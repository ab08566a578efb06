"""Sister candidates of a brand by their code sets (P7): a set-similarity self-join.

Products of a brand with equal sets are one class. Two classes are sisters where the
Jaccard similarity of their sets reaches the threshold. No pairs are formed of all the
classes that share a code: codes are ordered from the rarest of the brand to the most
frequent, and two similar sets must share a code within short prefixes of that order.
How short depends on both sizes, so a class is looked up once per band of partner
sizes, with the prefix that band needs. Where a key still gathers many classes, these
meet by a second shared code besides, which pairs that need two codes in common have
within prefixes longer by one.

Null brands, null ids and empty sets have no sisters. Equal rows are copies of one
class. Work grows with prefix codes and candidates; a set's row is its only
unbounded value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import saved

BAND = 1.1  # partner sizes up to 12 are exact bands, larger ones lie in bands of 10 %
HOT_PAIRS = 250_000  # a key that would form more pairs is split by a second code


def code_set(codes: Column) -> Column:
    """Codes joined by spaces (P6) as a sorted set."""
    return F.array_sort(F.array_distinct(F.filter(F.split(codes, " "), lambda c: c != "")))


def sister_classes(products: DataFrame, codes: str = "codes") -> DataFrame:
    """(brandId, class_id, set, copies): products of a brand with equal, non-empty sets;
    the class id is its smallest SKU id."""
    sets = products.select("brandId", "brandSKUId", code_set(F.col(codes)).alias("set"))
    return (sets.filter(F.col("brandId").isNotNull() & F.col("brandSKUId").isNotNull() & (F.size("set") > 0))
            .groupBy("brandId", "set").agg(F.min("brandSKUId").alias("class_id"), F.count(F.lit(1)).alias("copies")))


def _ceil(c: Column) -> Column:
    return F.ceil(c - F.lit(1e-9)).cast("int")


def _band(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / F.lit(math.log(BAND)) + F.lit(1e-9)).cast("int")


def _overlap(a: Column, b: Column, threshold: float) -> Column:
    """Codes that sets of two sizes must share."""
    return _ceil((a + b) * F.lit(threshold / (1.0 + threshold)))


def _by_rarity(classes: DataFrame) -> DataFrame:
    """(brandId, class_id, s, codes): the codes from the brand's rarest on."""
    code = classes.select("brandId", "class_id", F.explode("set").alias("code"))
    often = code.groupBy("brandId", "code").agg(F.count(F.lit(1)).alias("often"))
    return (code.join(often, ["brandId", "code"]).groupBy("brandId", "class_id")
            .agg(F.array_sort(F.collect_list(F.struct("often", "code"))).alias("codes"))
            .select("brandId", "class_id", F.size("codes").alias("s"), F.col("codes.code").alias("codes")))


def _lookups(ordered: DataFrame, threshold: float) -> DataFrame:
    """A row per class, band of partner sizes and prefix code."""
    s, other = F.col("s"), F.col("other")
    least = F.greatest(_ceil(F.pow(F.lit(BAND), other) * F.lit(1.0 - 1e-9)), _ceil(s * F.lit(threshold)))
    bands = F.sequence(_band(_ceil(s * F.lit(threshold))),
                       _band(F.floor(s / F.lit(threshold) + F.lit(1e-9)).cast("int")))
    rows = (ordered.withColumn("mine", _band(s)).withColumn("other", F.explode(bands))
            .withColumn("need", _overlap(s, least, threshold)).filter("s >= need"))
    more = F.array_except(F.slice("codes", 1, F.col("s") - F.col("need") + 2), F.array("code"))
    return (rows.select("*", F.posexplode(F.slice("codes", 1, F.col("s") - F.col("need") + 1)).alias("at", "code"))
            .select("brandId", "class_id", "s", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"),
                    (F.col("mine") <= other).alias("left"), (F.col("mine") >= other).alias("right"), "at", "code",
                    F.when(F.col("need") >= 2, more).alias("more")))


def candidates(classes: DataFrame, threshold: float, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(brandId, a, b): pairs of classes that may reach the threshold; none that do is missing."""
    key = ["brandId", "code", "lo", "hi"]
    looks = saved(_lookups(_by_rarity(classes), threshold))
    n = lambda side: F.sum(F.col(side).cast("long"))
    hot = (looks.groupBy(*key).agg((n("left") * n("right")).alias("pairs"))
           .filter(F.col("pairs") > hot_pairs).select(*key, F.lit(True).alias("hot")))
    split = F.when(F.col("hot") & F.col("more").isNotNull(), F.col("more")).otherwise(F.array(F.lit("")))
    dealt = saved(looks.join(hot, key, "left").withColumn("second", F.explode(split)).drop("more", "hot"))
    a, b = dealt.filter("left").alias("a"), dealt.filter("right").alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*key, "second"]]
    # the first shared code leaves room for enough others behind it
    room = F.least(F.col("a.s") - F.col("a.at"), F.col("b.s") - F.col("b.at"))
    fits = room >= _overlap(F.col("a.s"), F.col("b.s"), threshold)
    once = (F.col("a.lo") < F.col("a.hi")) | (F.col("a.class_id") < F.col("b.class_id"))
    cond = fits & once
    for c in same:
        cond = cond & c
    return (a.join(b, cond).select(F.col("a.brandId").alias("brandId"), F.col("a.class_id").alias("a"),
                                   F.col("b.class_id").alias("b")).distinct())


def sister_pairs(classes: DataFrame, threshold: float, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(brandId, a, b, similarity): all pairs of classes at or over the threshold, each once
    with the smaller id first."""
    if not 0.1 <= threshold <= 1.0:
        raise ValueError("threshold must lie between 0.1 and 1")
    sets = lambda side: classes.select("brandId", F.col("class_id").alias(side), F.col("set").alias(f"set_{side}"))
    both = (candidates(classes, threshold, hot_pairs).join(sets("a"), ["brandId", "a"]).join(sets("b"), ["brandId", "b"])
            .withColumn("shared", F.size(F.array_intersect("set_a", "set_b"))))
    union = F.size("set_a") + F.size("set_b") - F.col("shared")
    return (both.withColumn("similarity", F.col("shared").cast("double") / union)
            .filter(F.col("similarity") >= threshold)
            .select("brandId", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity"))


def sisters(products: DataFrame, threshold: float = 0.5, codes: str = "codes") -> DataFrame:
    """One row per product: its class, how many other products of the brand are its
    sisters (copies too), and the highest similarity among them (null without any)."""
    classes = saved(sister_classes(products, codes))
    pairs = saved(sister_pairs(classes, threshold))
    ends = pairs.select("brandId", F.col("a").alias("class_id"), F.col("b").alias("to"), "similarity").union(
        pairs.select("brandId", "b", "a", "similarity"))
    size = classes.select("brandId", F.col("class_id").alias("to"), "copies")
    linked = (ends.join(size, ["brandId", "to"]).groupBy("brandId", "class_id")
              .agg(F.sum("copies").alias("others"), F.max("similarity").alias("best")))
    found = classes.join(linked, ["brandId", "class_id"], "left").select(
        "brandId", "set", "class_id",
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_sisters"),
        F.when(F.col("copies") > 1, F.lit(1.0)).otherwise(F.col("best")).alias("top_similarity"))
    rows = products.select("brandId", "brandSKUId", code_set(F.col(codes)).alias("set"))
    rows = rows.withColumn("set", F.when(F.col("brandSKUId").isNotNull(), F.col("set")))
    return (rows.join(found, ["brandId", "set"], "left")
            .select("brandId", "brandSKUId", "class_id", F.coalesce("n_sisters", F.lit(0)).cast("long").alias("n_sisters"),
                    "top_similarity"))
