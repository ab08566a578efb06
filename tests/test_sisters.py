"""All sister candidates of a brand against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from skufold.operators.sisters import candidates, sister_classes, sister_pairs, sisters

SCHEMA = "brandId string, brandSKUId string, codes string"


def brute(rows, threshold):
    sets = {(b, k): frozenset((c or "").split()) for b, k, c in rows}
    found = {}
    for (b1, k1), (b2, k2) in itertools.combinations(sorted(sets), 2):
        x, y = sets[b1, k1], sets[b2, k2]
        if b1 == b2 and x and y and len(x & y) / len(x | y) >= threshold:
            for k, o in ((k1, k2), (k2, k1)):
                found.setdefault((b1, k), []).append(len(x & y) / len(x | y))
    return found


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.choice([0, 1, 1, 2, 2, 3, 4, 5, 6, 9, 14, 30])
        words = [f"C{min(int(rng.paretovariate(0.6)), 60)}" for _ in range(size)]
        rows.append((rng.choice("aab"), f"s{i:04d}", " ".join(words)))
    return rows


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("hot_pairs", [10, 10**9])
def test_pairs_equal_brute_force(spark, threshold, hot_pairs):
    rows = made(250, 3)
    classes = sister_classes(spark.createDataFrame(rows, SCHEMA)).cache()
    ids = {(r.brandId, r.class_id): frozenset(r["set"]) for r in classes.collect()}
    want = {(b1, a, b): len(x & y) / len(x | y)
            for ((b1, a), x), ((b2, b), y) in itertools.combinations(sorted(ids.items()), 2)
            if b1 == b2 and len(x & y) / len(x | y) >= threshold}
    got = sister_pairs(classes, threshold, hot_pairs).collect()
    assert {(r.brandId, r.a, r.b): r.similarity for r in got} == want and len(got) == len(want)


def test_rows_equal_brute_force(spark):
    rows = made(200, 5)
    got = {(r.brandId, r.brandSKUId): (r.n_sisters, r.top_similarity)
           for r in sisters(spark.createDataFrame(rows, SCHEMA), 0.5).collect()}
    want = brute(rows, 0.5)
    assert got == {(b, k): (len(want.get((b, k), [])), max(want.get((b, k), [None]))) for b, k, _ in rows}


def test_a_code_of_half_a_brand_forms_few_pairs(spark):
    """Every set holds one of four frequent codes and two rare ones: 4.5 million pairs share
    a frequent code, and hardly any is looked at."""
    rows = spark.range(6000).select(
        F.lit("a").alias("brandId"), F.format_string("s%05d", "id").alias("brandSKUId"),
        F.concat_ws(" ", F.concat(F.lit("F"), F.col("id") % 4), F.concat(F.lit("R"), F.floor(F.col("id") / 2)),
                    F.concat(F.lit("Q"), F.col("id") % 1500)).alias("codes"))
    classes = sister_classes(rows).cache()
    assert classes.count() == 6000
    assert candidates(classes, 0.5).count() < 30_000
    assert sister_pairs(classes, 0.5).count() == sister_pairs(classes, 0.5, 100).count()


def test_sets_of_frequent_codes_are_split_by_a_second_code(spark):
    """Sets made of frequent codes only: a key's classes meet by a second code."""
    rows = [("a", f"s{i:04d}", " ".join(f"C{j}" for j in c)) for i, c in enumerate(itertools.combinations(range(12), 5))]
    classes = sister_classes(spark.createDataFrame(rows, SCHEMA)).cache()
    few, many = (candidates(classes, 0.6, h) for h in (100, 10**9))
    assert few.count() <= many.count()
    assert sister_pairs(classes, 0.6, 100).count() == sister_pairs(classes, 0.6, 10**9).count() == 792 * 35 // 2


def test_nulls_copies_empty(spark):
    rows = [("a", "1", "X Y"), ("a", "2", "Y X X"), ("a", "3", None), ("a", "4", ""), (None, "5", "X Y"),
            ("a", None, "X Y"), ("b", "6", "X Y")]
    got = sorted(((r.brandId or "", r.brandSKUId or "", r.class_id, r.n_sisters, r.top_similarity)
                  for r in sisters(spark.createDataFrame(rows, SCHEMA)).collect()), key=lambda r: r[:2])
    assert got == [("", "5", None, 0, None), ("a", "", None, 0, None), ("a", "1", "1", 1, 1.0), ("a", "2", "1", 1, 1.0),
                   ("a", "3", None, 0, None), ("a", "4", None, 0, None), ("b", "6", "6", 0, None)]
    assert sisters(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        sister_pairs(spark.createDataFrame([], "brandId string, class_id string, set array<string>, copies long"), 0.0)
