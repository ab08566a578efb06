"""Versioned tables that change by one appended file.

A store is a folder of tables. A change writes new data files and a new index
(key -> file) beside the old ones (``stage``); one appended line of the store's
manifest then makes it, and all that is staged with it, the current state
(``commit``). Readers see the state before or the state after, a job that dies in
between leaves the old one, and nothing is overwritten or deleted. A commit may
carry a tag; a tag that is there already is not committed again, so that a replayed
batch changes nothing.

Keys (brands, batches, buckets) are clustered by range into files of about
``target_rows``, so that very many small keys make few files, a key of that size at
most lies in one file, and a larger one in several. The index names the files of a
key, and a file's rows count only for the keys that the index still gives it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir

TARGET_ROWS = 250_000
CSV = {"header": True, "escape": '"'}
MANIFEST = "version long, tag string, tables map<string,string>"


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).json(f"{self.path}/_manifest")
        except AnalysisException:  # nothing has been committed yet
            return self.spark.createDataFrame([], MANIFEST)

    def state(self) -> dict[str, dict]:
        """Tables of the current version."""
        row = self._manifest().orderBy(F.desc("version")).first()
        return {} if row is None else {name: json.loads(x) for name, x in row.tables.items()}

    def has_tag(self, tag: str) -> bool:
        return not self._manifest().filter(F.col("tag") == tag).isEmpty()

    def commit(self, staged: dict[str, dict], tag: str | None = None) -> bool:
        """Make staged tables current, all at once; False if the tag was there."""
        manifest = self._manifest()
        if tag is not None and not manifest.filter(F.col("tag") == tag).isEmpty():
            return False
        version = (manifest.agg(F.max("version")).first()[0] or 0) + 1
        tables = {name: json.dumps(x) for name, x in (self.state() | staged).items()}
        (self.spark.createDataFrame([(version, tag, tables)], MANIFEST).coalesce(1)
         .write.mode("append").json(f"{self.path}/_manifest"))
        return True

    def stage(self, name: str, rows: DataFrame, key: str, fmt: str = "parquet",
              target_rows: int = TARGET_ROWS, replace: bool = True) -> dict:
        """Write rows; the table that results has them instead of all that it holds of
        their keys (``replace``), or besides. CSV files have headers."""
        ensure_checkpoint_dir(self.spark)
        sizes = rows.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
        total = sizes.agg(F.sum("_n")).first()[0] or 0
        salts = sizes.select("_k", F.ceil(F.col("_n") / target_rows).cast("int").alias("_salts"))
        whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns if "map" not in dict(rows.dtypes)[c]])
        dealt = (rows.join(salts, F.col(key).eqNullSafe(F.col("_k")))
                 .withColumn("_s", F.pmod(F.xxhash64(whole), F.col("_salts")))
                 .repartitionByRange(max(1, -(-total // target_rows)), key, "_s")
                 .sortWithinPartitions(key).select(*rows.columns))
        data = f"{self.path}/{name}/data-{uuid.uuid4().hex[:12]}"
        dealt.write.options(**CSV if fmt == "csv" else {}).format(fmt).save(data)
        schema = rows.schema.json()
        new = (self._load([data], fmt, schema).select(F.col(key).alias("key"), F.col("_metadata.file_path").alias("file"))
               .distinct())
        old = self.state().get(name)
        if old is not None:
            kept = self.spark.read.parquet(old["index"])
            if replace:
                kept = kept.join(new.select("key").distinct(), "key", "left_anti")
            new = kept.unionByName(new)
        index = f"{self.path}/{name}/index-{uuid.uuid4().hex[:12]}"
        new.coalesce(1).write.parquet(index)
        return {"index": index, "key": key, "format": fmt, "schema": schema}

    def replace(self, name: str, rows: DataFrame, key: str, tag: str | None = None, **options) -> bool:
        """Stage and commit one table."""
        if tag is not None and self.has_tag(tag):
            return False
        return self.commit({name: self.stage(name, rows, key, **options)}, tag)

    def _load(self, paths: list[str], fmt: str, schema: str) -> DataFrame:
        reader = self.spark.read.schema(StructType.fromJson(json.loads(schema)))
        return reader.options(**CSV | {"multiLine": True} if fmt == "csv" else {}).format(fmt).load(paths)

    def index(self, name: str) -> DataFrame:
        """(key, file) of a table's current version."""
        return self.spark.read.parquet(self.state()[name]["index"])

    def read(self, name: str, keys: DataFrame | None = None) -> DataFrame | None:
        """A table's current rows, or those of some keys (one column, ``key``), from
        their files alone; None if there is no such table. The driver holds the names of the files."""
        table = self.state().get(name)
        if table is None:
            return None
        index = self.spark.read.parquet(table["index"])
        if keys is not None:
            index = index.join(keys.select("key").distinct(), "key", "left_semi")
        files = [r.file for r in index.select("file").distinct().collect()]
        if not files:
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(table["schema"])))
        rows = self._load(files, table["format"], table["schema"])
        at = index.select(F.col("key").alias("_k"), F.col("file").alias("_f"))
        return (rows.withColumn("_file", F.col("_metadata.file_path"))
                .join(at, F.col(table["key"]).eqNullSafe(F.col("_k")) & (F.col("_file") == F.col("_f")), "left_semi")
                .drop("_file"))
