"""S3: catalog tables from a relational database through Spark's JDBC source.

Connection options (url, user, password, driver) always come from the caller;
nothing is built into the library. Reads are split over ``num_partitions``
range queries on a numeric column when one is given, so no single task pulls
a whole table. Id filters are joins on the Spark side, never SQL text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .catalog import Catalog

DEFAULT_TABLES = {
    "sku": "sku", "brand": "brand", "category": "category",
    "sku_category": "sku_category", "seller_brand": "seller_brand",
}


def read_jdbc_table(spark: SparkSession, options: dict, table: str,
                    partition_column: str | None = None, lower: int | None = None,
                    upper: int | None = None, num_partitions: int | None = None) -> DataFrame:
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if partition_column:
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", str(lower)).option("upperBound", str(upper))
                  .option("numPartitions", str(num_partitions or 64)))
    return reader.load()


def read_products_jdbc(spark: SparkSession, options: dict, tables: dict | None = None,
                       partitioning: dict | None = None) -> Catalog:
    """Catalog from JDBC. ``tables`` maps logical names to database tables (or
    sub-queries that rename columns to the catalog schema); ``partitioning``
    maps a logical name to (column, lower, upper, partitions)."""
    tables = {**DEFAULT_TABLES, **(tables or {})}
    partitioning = partitioning or {}

    def rd(name: str) -> DataFrame:
        part = partitioning.get(name)
        if part:
            return read_jdbc_table(spark, options, tables[name], *part)
        return read_jdbc_table(spark, options, tables[name])

    return Catalog(rd("sku"), rd("brand"), rd("category"), rd("sku_category"), rd("seller_brand"))


def write_jdbc(df: DataFrame, options: dict, table: str = "product_variant_groups",
               mode: str = "append") -> None:
    """K7: append results to a database table."""
    df.write.format("jdbc").options(**options).option("dbtable", table).mode(mode).save()
