"""CSV records read by many tasks equal Spark's own multi-line reader."""

import random

import pytest
from pyspark.sql import functions as F

from skufold.sources.files import PRODUCT_CSV_SCHEMA, read_batches, read_products_csv, skipped_batches
from skufold.sources.records import ends_inside, fields, read_records

HEADER = "brandSKUId,label,facets_jsonb,categoryLabel\n"


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "151")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_line_states():
    for line, inside, want in [("a,b", False, False), ("a,b", True, True), ('"a,b', False, True), ('a",b', False, False),
                               ('a""', True, True), ('a"', True, False), ('a",""', True, False), ('a","', True, True),
                               ('"a"x"y,z', False, False), ('"a""', False, True), ('"', True, False), ("", True, True),
                               ('5" pipe,"x""y', False, True)]:
        assert ends_inside(line, inside) is want, line


def adversarial(seed, end):
    rng = random.Random(seed)
    parts = ["a", "b c", '""', ",", "\n", "\n\n", end, "{", '""k"":""v""', "x" * 60, "é", "[,]"]
    rows = []
    for i in range(40):
        cells = [f"id{i}"]
        for _ in range(3):
            body = "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))
            plain = body.replace(",", "").replace("\n", "").replace("\r", "").replace('"', "")
            cells.append(rng.choice([f'"{body}"', plain, plain + '5" wide', ""]))
        rows.append(",".join(cells) + end)
    return HEADER.replace("\n", end) + "".join(rows)


@pytest.mark.parametrize("seed,end", [(1, "\n"), (3, "\r\n"), (4, "\n")])
def test_rows_equal_the_multi_line_reader(small_blocks, tmp_path, seed, end):
    spark = small_blocks
    p = tmp_path / "acme_products.csv"
    p.write_bytes(adversarial(seed, end).encode())
    want = (spark.read.option("header", True).option("escape", '"').option("multiLine", True)
            .schema(PRODUCT_CSV_SCHEMA).csv(str(p)).collect())
    assert read_records(spark, str(p)).rdd.getNumPartitions() > 8
    row = F.from_csv("text", "brandSKUId string, label string, facets_jsonb string, categoryLabel string",
                     {"escape": '"', "multiLine": "true"})
    got = read_records(spark, str(p)).filter("not first").select(row.alias("r")).select("r.*").collect()
    key = lambda r: tuple("" if x is None else x for x in r)
    assert len(want) == 40
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
    split = read_records(spark, str(p)).filter("not first").select(fields(F.col("text")).alias("f")).collect()
    assert sorted((tuple(r.f) for r in split), key=key) == sorted(map(tuple, want), key=key)


def test_files_do_not_share_states(small_blocks, tmp_path):
    (tmp_path / "a_products.csv").write_text(HEADER + '1,"never closed\n2,x,y,z\n' + "3,x,y,z\n" * 30)
    (tmp_path / "b_products.csv").write_text("﻿\n\n" + HEADER + '4,"x\n\ny",{},c\n\n\n5,NA,{},c')
    got = read_products_csv(small_blocks, [str(tmp_path / "a_products.csv"), str(tmp_path / "b_products.csv"),
                                           str(tmp_path / "none.csv")]).collect()
    assert sorted((r.brandLabel, r.brandSKUId) for r in got) == [("A", "1"), ("B", "4"), ("B", "5")]
    rows = {r.brandSKUId: r.label for r in got}
    assert rows["4"] == "x\n\ny" and rows["5"] is None and rows["1"].startswith("never closed\n2,x")


def test_batches_of_many_headers_in_one_scan(spark, tmp_path):
    for i in range(150):
        cols = ["brandId", "cluster_id", "brandSKUId", f"extra{i % 3}"]
        cols = cols[i % 4:] + cols[:i % 4]
        values = {"brandId": "b", "cluster_id": str(i), "brandSKUId": '"s,\n1"', f"extra{i % 3}": f"e{i}"}
        (tmp_path / f"batch{i}_out.csv").write_text(",".join(cols) + "\n" + ",".join(values[c] for c in cols) + "\n")
    (tmp_path / "batch900_out.csv").write_text("brandId,brandSKUId\nb,s\n")
    (tmp_path / "batch901_out.csv").write_text("")
    glob = str(tmp_path / "*.csv")
    got = read_batches(spark, glob)
    assert got.columns == ["brandId", "cluster_id", "brandSKUId", "extra0", "extra1", "extra2", "batch_number"]
    rows = got.collect()
    assert sorted((r.batch_number, r.cluster_id, r.brandSKUId, r[f"extra{r.batch_number % 3}"]) for r in rows) == [
        (i, str(i), "s,\n1", f"e{i}") for i in range(150)]
    assert all(r[f"extra{(r.batch_number + 1) % 3}"] is None for r in rows)
    assert sorted((r.path.rsplit("/", 1)[1], r.reason) for r in skipped_batches(spark, glob).collect()) == [
        ("batch900_out.csv", "lacks cluster_id"), ("batch901_out.csv", "empty")]


def test_unreadable_parquet_batches_are_skipped(spark, tmp_path):
    spark.createDataFrame([("b", "0", "s")], "brandId string, cluster_id string, brandSKUId string").coalesce(1).write.parquet(
        str(tmp_path / "batch7"))
    (tmp_path / "batch7" / "part-bad.parquet").write_bytes(b"not parquet at all")
    got = read_batches(spark, str(tmp_path / "batch7" / "*.parquet"), "parquet").collect()
    assert [(r.brandId, r.brandSKUId, r.batch_number) for r in got] == [("b", "s", 7)]
