"""Sources, sinks, streaming and the driver contract."""

import os
import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from skufold.operators import results as res
from skufold.plans import flows
from skufold.sinks import writers as K
from skufold.sources.files import read_exclusions, read_products_csv
from skufold.streaming.incremental import incremental_upsert, read_master

from .conftest import SF001


def test_entry_contract(spark):
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q)
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert "total_products" in df.columns


def test_csv_source_and_brand_from_filename(spark):
    d = tempfile.mkdtemp(prefix="skufold-csv-")
    p = os.path.join(d, "corn-itos_products.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write('brandSKUId,label,facets_jsonb,categoryLabel\n')
        f.write('1,Cornitos Nachos 150g,"{""netWeight"":""150g""}",Snacks/Chips\n')
        f.write('2,NA,{},Snacks\n')
    df = read_products_csv(spark, [p, os.path.join(d, "missing.csv"), os.path.join(d, "x.txt")])
    rows = {r.brandSKUId: r for r in df.collect()}
    assert rows["1"].brandLabel == "Corn-Itos"
    assert rows["1"].facets_jsonb == '{"netWeight":"150g"}'
    assert rows["2"].label is None
    assert read_exclusions(spark, os.path.join(d, "none.csv")).count() == 0


def test_sinks_and_idempotent_master(spark):
    det = flows.identity_detailed(spark, SF001).withColumn("batch_number", F.lit(1))
    base = tempfile.mkdtemp(prefix="skufold-out-")
    K.write_brand_json(det, f"{base}/json")
    K.write_cluster_summary(det, f"{base}/summary")
    K.write_master(det, f"{base}/master")
    K.write_master(det, f"{base}/master")
    back = K.read_sink(spark, f"{base}/master")
    assert back.count() == det.count()
    K.write_batch(det, f"{base}/batches")
    n = K.write_representatives(res.representatives(det), f"{base}/reps")
    assert n == 1
    assert K.read_sink(spark, f"{base}/json").count() > 0


def test_streaming_upsert_equals_batch(spark):
    det = flows.identity_detailed(spark, SF001).select("brandId", "brandSKUId", "cluster_id")
    base = tempfile.mkdtemp(prefix="skufold-stream-")
    det.write.parquet(f"{base}/in/part1")
    q = incremental_upsert(spark, f"{base}/in/part1", det.schema, f"{base}/master", f"{base}/ckpt")
    q.awaitTermination(120)
    got = read_master(spark, f"{base}/master").select("brandId", "brandSKUId", "cluster_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, det.collect()))
