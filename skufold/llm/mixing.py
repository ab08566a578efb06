"""Mixing sources to target weights.

Sources get shares of a word budget by weight; a target never exceeds
``max_epochs`` times what its source holds, and the excess goes to the other
sources by weight. Rows are put in a hash-random order inside their source;
the order is cut at the exact budget, so a source that must be repeated gives
whole epochs first and then a prefix of the same order, the last row in part.

Spark plan: one scan of the texts makes a thin table (id, source, size, random
key), written once. The key's leading hex digits range-partition every source
into equal buckets, so a source with a third of all rows is spread over many
tasks. Bucket sums are partial aggregates; their prefix sums (one row per source
and bucket) plus a running sum inside each bucket give every row its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, fresh, row_key, word_count, written

#: Rows of one bucket on average, and the most hex digits that number buckets.
ROWS_PER_BUCKET = 512
MAX_DIGITS = 7


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), ratio: float = 1.5,
                   max_epochs: int = 2) -> DataFrame:
    """(source, source_size) -> + target double.

    Sources by code point, null last, take the weights in turn and share
    ``ratio`` of all sizes. With limits r = max_epochs * size / weight in rising
    order, the sources held at their limit are a prefix of that order, so the
    water level is found with prefix sums instead of repeated rounds (one source too
    many in the prefix lowers the level, so it is the highest that fits). One row per
    source: the two global windows are over that small table only. Empty sources
    get 0; without any word every target is 0.
    """
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]),
                     (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("_rank", F.row_number().over(by_name)).withColumn("_w", w)
    by_limit = Window.orderBy("_r", "_rank")
    limits = (ranked.withColumn("_cap", F.lit(max_epochs) * F.col("source_size"))
              .withColumn("_r", F.col("_cap") / F.col("_w"))
              .withColumn("_held", F.sum("_cap").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)))
              .withColumn("_open", F.sum("_w").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
              .withColumn("_all", F.sum("source_size").over(Window.partitionBy())))
    level = (F.lit(float(ratio)) * F.col("_all") - F.coalesce("_held", F.lit(0))) / F.col("_open")
    limits = limits.withColumn("_level", level)
    free = limits.withColumn("_line", F.max(F.when(F.col("_level") <= F.col("_r"), F.col("_level")))
                             .over(Window.partitionBy()))
    target = F.when(F.col("_line").isNull(), F.col("_cap").cast("double")).otherwise(
        F.least(F.col("_cap").cast("double"), F.col("_line") * F.col("_w")))
    return free.select("source", "source_size", target.alias("target"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple[int, ...] = (3, 1, 2), ratio: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, row_key.

    ``size`` counts words (null or empty text: 0, never taken). Every source's
    ``taken`` sums to the whole part of its target. Ties of the random key are
    ordered by id and size; rows that repeat exactly are interchangeable. A null
    source is a source of its own, a null id is ordered by its text. An empty
    table gives an empty result. Other columns of docs are not read.
    """
    text = F.col(text_col)
    thin = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"),
        row_key(F.col(id_col), text).alias("row_key"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), text, F.lit(""))).alias("_key"))
    thin = written(thin.withColumn("_s", F.coalesce("source", F.lit("")))
                   .withColumn("_n", F.col("source").isNull()))
    rows, digits = thin.count(), 0
    while digits < MAX_DIGITS and rows > ROWS_PER_BUCKET * 16 ** digits:
        digits += 1
    keys = ["_s", "_n", "_bucket"]
    thin = thin.withColumn("_bucket", F.substring("_key", 1, digits) if digits else F.lit(""))
    buckets = thin.groupBy(*keys).agg(F.sum("size").alias("_sum"))
    totals = (buckets.groupBy("_s", "_n").agg(F.sum("_sum").alias("source_size"))
              .withColumn("source", F.when(~F.col("_n"), F.col("_s"))))
    targets = source_targets(totals.select("source", "source_size"), weights, ratio, max_epochs)
    targets = (targets.withColumn("_s", F.coalesce("source", F.lit("")))
               .withColumn("_n", F.col("source").isNull()).drop("source"))
    before = Window.partitionBy("_s", "_n").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    offsets = written(offsets.join(targets, ["_s", "_n"]))
    inside = Window.partitionBy(*keys).orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (thin.join(offsets, keys)
              .withColumn("_start", F.col("_offset") + F.sum("size").over(inside) - F.col("size")))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size") - F.col("_start")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select("doc_id", "source", "size", "source_size", "target",
                         taken.cast("long").alias("taken"), "row_key")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        **options) -> DataFrame:
    """The mixed corpus: docs' rows and columns, a row repeated per epoch.

    The row at a source's cut keeps its first words, white space unchanged;
    a column ``n_chars`` is set to the new length. Rows of no words are never
    taken. Texts are joined to the plan by a digest of id and text, so nothing
    is hot; rows that repeat exactly share their copies.
    """
    plan = plan_mix(docs, id_col, text_col, source_col, **options).filter("taken > 0")
    key, full, part, cut = fresh(docs, "_llm_key", "_llm_full", "_llm_part", "_llm_cut")
    copies = plan.groupBy(F.col("row_key").alias(key)).agg(
        F.sum(F.expr("taken div size")).alias(full),
        F.sum(F.expr("taken % size")).alias(part))
    keyed = (docs.withColumn(key, row_key(F.col(id_col), F.col(text_col)))
             .dropDuplicates([key]).join(copies, key))
    pieces = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col(full).cast("int")),
                      F.when(F.col(part) > 0, F.array(part))
                      .otherwise(F.array().cast("array<long>")))
    out = keyed.withColumn(cut, F.explode(pieces))
    words = F.split(F.col(text_col), rf"(?<={WS})(?=[^\x20\x09-\x0D])")
    lead = F.when(F.col(text_col).rlike(rf"^{WS}"), 1).otherwise(0)
    short = F.array_join(F.slice(words, 1, (F.col(cut) + lead).cast("int")), "")
    text = F.when(F.col(cut) < 0, F.col(text_col)).otherwise(short)
    out = out.withColumn(text_col, text)
    if "n_chars" in docs.columns and text_col != "n_chars":
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
