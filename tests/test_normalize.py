"""Unit fixtures for N1-N13, F3, F6 (FIXTURES.md section 3)."""

import pytest
from pyspark.sql import functions as F

from skufold.functions import pyregex as rx
from skufold.functions.categories import parse_categories
from skufold.operators.prepare import IdentityConfig, process_products

NORMALIZE = [
    ("EVEREST GARAM MASALA 50g. 50 Grams", "{}", "Everest", "garam masala"),
    ("Lays American Style Cream & Onion Flavour Potato Chips 52g",
     '{"flavour":"American Style Cream & Onion","netWeight":"52g"}', "Lays",
     "american style cream onion flavour potato chips"),
    ("Burfi 1.5 kg", "{}", "X", "burfi"),
    ("Burfi 1.5kg", "{}", "X", "burfi"),
    ("Lays Chips", "{}", "Lay", "chips"),
    ("Bars 5 box", "{}", "X", "bars 5 box"),
    ("7UP", "{}", "7UP", "7up"),
    ("Haldiram's Bhujia (pouch)", "{}", "Haldiram", "bhujia"),
    ("New Classic Tea 250 ml", "{}", "X", "classic tea"),
]


def _frame(spark, rows, cat="Sweets/Snacks"):
    return spark.createDataFrame([(i, r[0], r[1], r[2], cat) for i, r in enumerate(rows)],
                                 "id int, label string, facets_jsonb string, brandLabel string, categoryLabel string")


def test_normalize_fixtures(spark):
    out = {r.id: r for r in process_products(_frame(spark, NORMALIZE)).collect()}
    for i, (_, _, _, expected) in enumerate(NORMALIZE):
        assert out[i].normalized_name == expected, (NORMALIZE[i], out[i].normalized_name)
        assert out[i].row_status == "ok"


def test_null_label_is_fallback_not_failure(spark):
    df = spark.createDataFrame([(1, None, "{}", "X", "Sweets/Snacks")],
                               "id int, label string, facets_jsonb string, brandLabel string, categoryLabel string")
    r = process_products(df).collect()[0]
    assert r.row_status == "fallback"
    assert r.normalized_name is None
    assert r.core_identity == "None | Sweets/Snacks"
    assert r.primary_category == "Sweets"


def test_non_object_facets_fall_back(spark):
    rows = [("Tea 250 ml", '["a"]', "X"), ("Tea 250 ml", "5", "X"), ("Tea 250 ml", "[]", "X"),
            ("Tea 250 ml", "not json", "X")]
    out = process_products(_frame(spark, rows)).orderBy("id").collect()
    assert [r.row_status for r in out] == ["fallback", "fallback", "ok", "ok"]
    assert out[0].core_identity == "tea | Sweets/Snacks"


@pytest.mark.parametrize("inp,expected", [
    ("Sweets/Snacks", ["Sweets", "Snacks"]),
    ("Sweets/Snacks, Fried", ["Sweets", "Snacks, Fried"]),
    ("N/A", ["general"]),
    (None, ["general"]),
    ("", ["general"]),
    (" / ", ["general"]),
    ("A;B", ["B"]),
])
def test_parse_categories(spark, inp, expected):
    df = spark.createDataFrame([(inp,)], "c string")
    assert df.select(parse_categories(F.col("c")).alias("x")).first().x == expected


def test_facets_identity(spark):
    f = ('{"tags":["corn chips","","n/a"],"veg":"✅ Yes","spice":2,"x":null,"o":{"a":1},'
         '"flavour":"Peri Peri"}')
    df = _frame(spark, [("Corn chips", f, "X")])
    r = process_products(df, IdentityConfig(use_facets=True)).first()
    assert r.core_identity == "category:sweets snacks | tags:corn chips | veg:yes | spice:2 | flavour:peri peri"


def test_core_and_simple_identity(spark):
    df = _frame(spark, [("EVEREST GARAM MASALA 50g. 50 Grams", "{}", "Everest")], cat="Spices/Blends")
    assert process_products(df).first().core_identity == "garam masala | spices"
    assert process_products(df, IdentityConfig(simple_identity=True)).first().core_identity == "everest | spices"


def test_python_word_classes(spark):
    df = spark.createDataFrame([("लड्डू 5g é-x",)], "s string")
    got = df.select(F.regexp_replace("s", rx.SPECIAL, "#").alias("x")).first().x
    assert got == "लड#ड# 5g é#x"


def test_strip_unicode_spaces(spark):
    df = spark.createDataFrame([("  tea  ",)], "s string")
    assert df.select(rx.strip(F.col("s")).alias("x")).first().x == "tea"


def test_rows_are_dealt_to_all_cores(spark):
    """One small partition of rows, whose work is regexes, does not stay one task."""
    rows = spark.range(400).selectExpr("id as brandSKUId", "concat('soap ', id, ' 50g') as label", "'x' as categoryLabel",
                                       "'b' as brandLabel").coalesce(1)
    tasks = process_products(rows).select(F.spark_partition_id().alias("p"), "normalized_name").filter(
        "normalized_name is not null").groupBy("p").count().collect()
    assert len(tasks) >= 8 and sum(t["count"] for t in tasks) == 400
