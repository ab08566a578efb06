"""Term weights and vectors of a brand's products, stable per brand (V1).

A product's document is the terms of its cleaned identity. A term's weight is its
count times ``ln((n + 1) / (df + 1)) + 1``, n the products of the *brand* and df those
of them that hold the term; the one added keeps a term of every product from being
nothing. Terms fall into buckets by the first 32 bits of their MD5, and weights are
divided by the product's Euclidean norm. So a brand's vectors are the same whatever
other brands are in the run.

Frequencies come from the rows given, or from a ``FrequencyStore`` that is brought up
to date batch by batch. Rows of one SKU are one document with all their terms; null
brands or ids have no terms. Frequencies are a table keyed by (brand, term) and are
joined, not broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import clean_identity
from ..sinks.snapshots import SnapshotStore

DIMS = 384
KEYS = ["brandId", "brandSKUId"]
TABLE = "document_frequencies"


def terms(products: DataFrame, identity: str = "core_identity") -> DataFrame:
    """(brandId, brandSKUId, term, tf); a product without any term has one row, term null."""
    words = F.filter(F.split(F.lower(clean_identity(F.col(identity))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    rows = (products.filter(F.col("brandId").isNotNull() & F.col("brandSKUId").isNotNull())
            .select(*KEYS, F.explode_outer(words).alias("term")))
    return rows.groupBy(*KEYS, "term").agg(F.count(F.lit(1)).alias("tf"))


def frequencies(term_rows: DataFrame) -> DataFrame:
    """(brandId, term, df); the row whose term is null counts the brand's products."""
    df = term_rows.filter("term is not null").groupBy("brandId", "term").agg(F.count(F.lit(1)).alias("df"))
    n = (term_rows.groupBy(*KEYS).agg(F.lit(1).alias("one")).groupBy("brandId").agg(F.count(F.lit(1)).alias("df"))
         .select("brandId", F.lit(None).cast("string").alias("term"), "df"))
    return df.unionByName(n)


class FrequencyStore:
    """Document frequencies in versions: a batch is added, or replaces its brands, by one
    commit. A batch whose tag was committed changes nothing when it is run again."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = SnapshotStore(spark, path)

    def add(self, products: DataFrame, tag: str, identity: str = "core_identity") -> bool:
        """Count products that are new to the store."""
        return self._commit(products, tag, identity, replace=False)

    def replace(self, products: DataFrame, tag: str, identity: str = "core_identity") -> bool:
        """Count the brands of these products, given whole, anew."""
        return self._commit(products, tag, identity, replace=True)

    def _commit(self, products, tag, identity, replace) -> bool:
        rows = frequencies(terms(products, identity))
        return self.store.replace(TABLE, rows, "brandId", tag=tag, replace=replace)

    def read(self) -> DataFrame:
        """(brandId, term, df) of the current version, all batches added up."""
        rows = self.store.read(TABLE)
        if rows is None:
            raise ValueError("the store holds no frequencies yet")
        return rows.groupBy("brandId", "term").agg(F.sum("df").alias("df"))


def bucket(term: Column, dims: int = DIMS) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long"), F.lit(dims)).cast("int")


def weights(term_rows: DataFrame, freq: DataFrame, dims: int = DIMS) -> DataFrame:
    """(brandId, brandSKUId, bucket, weight), weights of a product of norm 1. A term that
    the frequencies do not know counts as held by no product."""
    df = freq.filter("term is not null")
    n = freq.filter("term is null").select("brandId", F.col("df").alias("n"))
    idf = F.log((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    raw = (term_rows.filter("term is not null").join(df, ["brandId", "term"], "left").join(n, "brandId", "left")
           .groupBy(*KEYS, bucket(F.col("term"), dims).alias("bucket")).agg(F.sum(F.col("tf") * idf).alias("w")))
    row = raw.groupBy(*KEYS).agg(F.collect_list(F.struct("bucket", "w")).alias("ws"))  # at most dims entries
    norm = F.sqrt(F.aggregate("ws", F.lit(0.0), lambda a, x: a + x.w * x.w))
    return (row.select(*KEYS, norm.alias("norm"), F.explode("ws").alias("x"))
            .select(*KEYS, "x.bucket", (F.col("x.w") / F.col("norm")).alias("weight")))


def vectors(products: DataFrame, identity: str = "core_identity", freq: DataFrame | None = None,
            dims: int = DIMS) -> DataFrame:
    """products with ``embedding`` (array<double> of ``dims``); all zeros without any term."""
    rows = terms(products, identity)
    sparse = weights(rows, frequencies(rows) if freq is None else freq, dims)
    dense = (sparse.groupBy(*[F.col(k).alias(f"_{k}") for k in KEYS])
             .agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("_w")))
    value = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)),
                        lambda i: F.coalesce(F.try_element_at(F.col("_w"), i), F.lit(0.0)))
    zeros = F.array_repeat(F.lit(0.0), dims)
    return (products.join(dense, [F.col(k) == F.col(f"_{k}") for k in KEYS], "left")
            .withColumn("embedding", F.when(F.col("_w").isNull(), zeros).otherwise(value))
            .drop("_w", *[f"_{k}" for k in KEYS]))
