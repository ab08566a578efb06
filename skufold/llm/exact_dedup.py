"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 of the
normalised text. A batch is reduced to one row per digest (map-side combined, so
a digest held by a third of all rows costs one row per task), anti-joined with
the index by sort-merge and appended. The index side of that join is read in its
buckets and needs no shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, keep_by_key, row_key, written


def normalised(text: Column) -> Column:
    """Every run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{WS}+", " ")


class DigestIndex:
    """A bucketed table (digest binary, keep_id, batch string) at a path.

    ``path`` must be in storage that all executors share. The catalog entry is
    only this session's handle; a later session opens the same path again with
    the same number of buckets.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, id_type: str = "bigint"):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid4().hex[:12]}"
        spark.sql(f"CREATE TABLE {self.table} (digest BINARY, keep_id {id_type}, batch STRING) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, fresh: DataFrame, batch: str) -> None:
        """Append (digest, keep_id), one file per bucket; the caller leaves out what the
        index already holds."""
        (fresh.select("digest", "keep_id", F.lit(batch).alias("batch"))
         .repartition(self.buckets, "digest").write.insertInto(self.table))

    def close(self) -> None:
        """Forget the session's handle; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest binary, row_key, _rid), one row per input row, written once."""
    return written(docs.select(
        F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"),
        row_key(F.col(id_col), F.col(text_col)).alias("row_key"),
        F.monotonically_increasing_id().alias("_rid")))


def dedup_batch(thin: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """Deduplicate a batch (from ``digests``) against the index and append it.

    Returns one row per input row: doc_id, keep_id, group_size (rows of the
    batch with that digest), kept, digest, row_key. The row of the smallest id
    stays (null ids last; of rows that repeat exactly, one); where the index
    already holds the digest from another batch, its row stays and none of the
    batch does. What the index holds from this batch is from a run of it that was
    lost after its append: it is no reason to drop anything, so the batch run again
    gives the first run's result and appends nothing. Null and empty texts are
    equal. An empty batch gives an empty result.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key", "_rid"))
    groups = thin.groupBy("digest").agg(first.alias("f"), F.count(F.lit(1)).alias("group_size"))
    others = index.read().filter(~F.col("batch").eqNullSafe(F.lit(batch)))
    known = others.select("digest", F.col("keep_id").alias("known_id"), F.lit(True).alias("known"))
    groups = written(groups.join(known, "digest", "left").select(
        "digest", "group_size", F.coalesce("known", F.lit(False)).alias("known"),
        F.when(F.col("known"), F.col("known_id")).otherwise(F.col("f.doc_id")).alias("keep_id"),
        F.when(F.col("known").isNull(), F.col("f._rid")).alias("keep_rid")))
    fresh = groups.join(index.read().select("digest"), "digest", "left_anti")
    index.append(fresh, batch)
    return thin.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("_rid") == F.col("keep_rid"), F.lit(False)).alias("kept"), "digest", "row_key")


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """docs' rows that stay, with docs' columns, whatever their names."""
    result = dedup_batch(digests(docs, id_col, text_col), index, batch)
    return keep_by_key(docs, result.filter("kept").select(F.col("row_key").alias("_key")), id_col, text_col)
