"""File sources: product CSVs (S1, S2), exclusion list (S4), batch outputs
(S5, S6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .records import fields, read_records

PRODUCT_CSV_SCHEMA = T.StructType([
    T.StructField("brandSKUId", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("facets_jsonb", T.StringType()),
    T.StructField("categoryLabel", T.StringType()),
])
# Fixed values (must equal pandas' default NA tokens, which the reference
# relies on when it reads CSVs).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
BATCH_REQUIRED = ["brandId", "cluster_id", "brandSKUId"]


def _listed(spark: SparkSession, path: str) -> list:
    """What a path or glob names in the file system that it belongs to."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return list(where.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(where) or [])


def _na_to_null(df: DataFrame, cols) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.when(F.col(c).isin(*NA_TOKENS), F.lit(None)).otherwise(F.col(c)))
    return df


def brand_from_filename(file_col="_file") -> F.Column:
    """``stem.replace('_products', '').title()``.

    Python's title() upper-cases a letter after any non-letter and lowers the
    rest; split into letter runs and separators and capitalize each run.
    """
    stem = F.regexp_replace(F.regexp_extract(F.col(file_col), r"([^/]*)$", 1), r"\.[^.]*$", "")
    stem = F.replace(stem, F.lit("_products"), F.lit(""))
    pieces = F.regexp_extract_all(stem, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    cap = F.transform(pieces, lambda p: F.when(p.rlike(r"^\p{L}"),
                                               F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30))))
                      .otherwise(p))
    return F.array_join(cap, "")


def read_products_csv(spark: SparkSession, paths) -> DataFrame:
    """S1 + S2: header CSVs with doubled-quote JSON; non-.csv or missing paths
    are dropped; brand = title-cased file stem; brandId = brand. A file is read by
    many tasks, line ends within quotes included."""
    if isinstance(paths, str):
        paths = [paths]
    keep = [p for p in paths if p.lower().endswith(".csv") and _listed(spark, p)]
    if not keep:
        return spark.createDataFrame([], PRODUCT_CSV_SCHEMA.add("brandLabel", T.StringType())
                                     .add("brandId", T.StringType()))
    row = F.from_csv("text", PRODUCT_CSV_SCHEMA.simpleString()[7:-1].replace(":", " "), {"escape": '"', "multiLine": "true"})
    df = (read_records(spark, keep).filter("not first").select(row.alias("r"), F.col("path").alias("_file"))
          .select("r.*", "_file"))
    df = _na_to_null(df, ["label", "facets_jsonb", "categoryLabel"])
    return (df.withColumn("brandLabel", brand_from_filename())
            .withColumn("brandId", F.col("brandLabel")).drop("_file"))


def read_exclusions(spark: SparkSession, path: str | None, column: str = "processed_brand_ids") -> DataFrame:
    """Ids not to process; a missing file means none."""
    schema = T.StructType([T.StructField(column, T.StringType())])
    if not path or not _listed(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.option("header", True).csv(path)
    if column not in df.columns:
        return spark.createDataFrame([], schema)
    return df.select(F.col(column).cast("string"))


def _headers(records: DataFrame) -> DataFrame:
    return records.filter("first").select("path", fields(F.col("text")).alias("names"))


def _lacking(names) -> F.Column:
    """Required columns that a header lacks."""
    return F.array_except(F.array(*map(F.lit, BATCH_REQUIRED)), F.coalesce(names, F.array().cast("array<string>")))


def read_batches(spark: SparkSession, path_glob: str, fmt: str = "csv") -> DataFrame:
    """All batch outputs with ``batch_number`` from the file name.

    CSV files are read by their own headers in one scan: header rows meet the
    data rows of their file, columns are taken by name (of equal names the first),
    and a file that lacks a required column contributes nothing (S6,
    ``skipped_batches``). The driver holds the names of the columns. Parquet files are
    read by their merged schema; unreadable ones are left out, and so are rows without
    a required value.
    """
    if fmt != "csv":
        df = spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", True).format(fmt).load(path_glob)
        if set(BATCH_REQUIRED) - set(df.columns):
            return _no_batches(spark)
        return df.dropna(subset=BATCH_REQUIRED).withColumn("batch_number", _batch_number("_metadata.file_path"))
    records = read_records(spark, path_glob)
    headers = _headers(records).filter(F.size(_lacking(F.col("names"))) == 0)
    names = sorted(r.name for r in headers.select(F.explode("names").alias("name")).distinct().collect() if r.name)
    if not names:
        return _no_batches(spark)
    names = BATCH_REQUIRED + [n for n in names if n not in BATCH_REQUIRED and n != "batch_number"]
    rows = (records.filter("not first").join(headers, "path")
            .select("path", "names", fields(F.col("text")).alias("values")))
    value = lambda n: F.when(F.array_contains("names", n), F.get("values", F.array_position("names", n).cast("int") - 1))
    return rows.select(*[value(n).alias(n) for n in names], _batch_number("path").alias("batch_number"))


def skipped_batches(spark: SparkSession, path_glob: str) -> DataFrame:
    """(path, reason): CSV batch files that ``read_batches`` leaves out."""
    files = (spark.read.format("binaryFile").load(path_glob)
             .select(F.col("_metadata.file_path").alias("path")))
    lacking = _lacking(F.col("names"))
    # Spark's readers never see files of no bytes
    nothing = [(f.getPath().toString(), "empty") for f in _listed(spark, path_glob) if f.isFile() and f.getLen() == 0]
    lacked = (files.join(_headers(read_records(spark, path_glob)), "path", "left").filter(F.size(lacking) > 0)
              .select("path", F.when(F.col("names").isNull(), "empty")
                      .otherwise(F.concat(F.lit("lacks "), F.array_join(lacking, ", "))).alias("reason")))
    return spark.createDataFrame(nothing, "path string, reason string").union(lacked)


def _batch_number(path: str) -> F.Column:
    return F.regexp_extract(F.col(path), r"batch(\d+)", 1).cast("int")


def _no_batches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{c} string" for c in BATCH_REQUIRED) + ", batch_number int")
