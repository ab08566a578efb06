"""Phonetics (P1-P7) and variant types."""

from pyspark.sql import functions as F

from skufold.functions import phonetic as ph
from skufold.operators import results as res


def test_soundex_codes(spark):
    df = spark.createDataFrame([("burfi",), ("burfee",), ("barfee",)], "w string")
    assert [r.c for r in df.select(ph.encode(F.col("w"), "soundex").alias("c")).collect()] == ["B610"] * 3


def test_similarity(spark):
    df = spark.createDataFrame([("B610", "B610"), ("B610", "L300"), ("", "B610")], "a string, b string")
    got = [r.s for r in df.select(ph.similarity("a", "b").alias("s")).collect()]
    assert got == [1.0, 0.0, 0.0]


def test_match_rating_codex(spark):
    df = spark.createDataFrame([("burfee",), ("catherine",)], "w string")
    got = [r.c for r in df.select(ph.match_rating_code(F.col("w")).alias("c")).collect()]
    assert got == ["BRF", "CTHRN"]


def test_tokens_drop_short_and_digits(spark):
    df = spark.createDataFrame([("Ab 12abc, x-yz!",)], "t string")
    assert df.select(ph.tokens(F.col("t")).alias("t")).first().t == ["abc"]


def test_python_codecs_run(spark):
    assert ph.metaphone("thompson")
    assert ph.nysiis("macintosh").startswith("MC")


def test_variant_types(spark):
    rows = [("b", 0, "s1", "Chips 38g"), ("b", 0, "s2", "Chips Masala 38g"),
            ("b", 1, "s3", "Tea 50g"), ("b", 1, "s4", "Tea 100g"), ("b", 1, "s5", "Tea 200g"),
            ("b", 2, "s6", "Dal 100g"), ("b", 2, "s7", "Dal 100g (box)"), ("b", 2, "s8", "Dal 200g"),
            ("b", 3, "s9", "Solo"), ("b", -1, "s10", "Noise 1")]
    df = spark.createDataFrame(rows, "brandId string, cluster_id int, brandSKUId string, label string")
    got = {r.cluster_id: r.variant_type for r in res.variant_type(df).collect()}
    assert got == {0: "type_variant", 1: "size_variant", 2: "mixed", 3: "single_product", -1: "no_sisters"}
