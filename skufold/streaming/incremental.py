"""Incremental upsert with Structured Streaming.

New detailed rows arrive as files; every micro-batch is merged into the master table,
a snapshot store, by (brandId, brandSKUId). Rows lie in buckets of their key's hash,
so a brand may be of any size and come in any number of files; a merge writes the
touched buckets anew, old rows with the batch's, and one appended manifest line makes
them current. A merge that dies leaves the table as it was, and a micro-batch that is
replayed after its commit is no change, told by its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir
from ..sinks.snapshots import SnapshotStore

MASTER, BUCKET, BUCKETS = "master", "_bucket", 256


def upsert_batch(batch: DataFrame, master_path: str, tag: str | None = None, buckets: int = BUCKETS) -> bool:
    """Merge a batch; of several rows of a key in it, the one that sorts last stays.
    False if the tag has been merged before. A table keeps its number of buckets."""
    spark = batch.sparkSession
    store = SnapshotStore(spark, master_path)
    if tag is not None and store.has_tag(tag):
        return False
    keys = ["brandId", "brandSKUId"]
    rest = [c for c in batch.columns if c not in keys]
    new = (batch.groupBy(*keys).agg(F.max(F.struct(*[F.col(c) for c in rest])).alias("_r"))
           .select(*keys, "_r.*").withColumn("processing_timestamp", F.current_timestamp())
           .withColumn(BUCKET, F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in keys]), F.lit(buckets)).cast("int")))
    ensure_checkpoint_dir(spark)
    new = new.checkpoint()
    old = store.read(MASTER, new.select(F.col(BUCKET).alias("key")))
    if old is not None:
        new = new.unionByName(old.join(new.select(*keys), keys, "left_anti"), allowMissingColumns=True)
    return store.replace(MASTER, new, BUCKET, tag)


def read_master(spark: SparkSession, master_path: str) -> DataFrame | None:
    """The merged rows; None before the first merge."""
    rows = SnapshotStore(spark, master_path).read(MASTER)
    return None if rows is None else rows.drop(BUCKET)


def incremental_upsert(spark: SparkSession, source_dir: str, schema: StructType, master_path: str,
                       checkpoint_location: str, fmt: str = "parquet", available_now: bool = True):
    """Start the stream; returns the StreamingQuery."""
    stream = spark.readStream.format(fmt).schema(schema).load(source_dir)
    writer = (stream.writeStream
              .foreachBatch(lambda df, epoch: upsert_batch(df, master_path, f"{checkpoint_location} {epoch}"))
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
