"""Whole runs from a source to every sink, with resume."""
import json

from pyspark.sql import functions as F

from skufold.operators.cluster import ClusterConfig
from skufold.plans import flows
from skufold.sources.catalog import derive_catalog

from .conftest import SF001


def test_catalog_run_writes_every_sink_and_resumes(spark, tmp_path):
    out = str(tmp_path / "out")
    cat = derive_catalog(spark, SF001)
    cfg = flows.RunConfig(batch_size=12, cluster=ClusterConfig(epsilon=0.1))
    batches = flows.run_catalog(cat, out, "r1", cfg).collect()
    store = flows.open_store(spark, out)
    master = store.read("master")
    n, brands = master.count(), master.select("brandId").distinct().count()
    assert n > 0 and sum(b.total_products for b in batches) == n
    assert sum(b.brands_processed for b in batches) >= brands and all(b.brands_in_batch <= 12 for b in batches)
    lines = store.read("brands")
    clusters, documents = lines.filter("products IS NOT NULL"), lines.filter("products IS NULL")
    assert clusters.agg(F.sum(F.size("products"))).first()[0] == n and clusters.filter("variant_type IS NULL").isEmpty()
    assert documents.agg(F.sum("total_products")).first()[0] == n and documents.count() == brands
    summary = store.read("cluster_summary")
    assert summary.count() == n and "variant_type" in summary.columns
    assert store.read("detailed").count() == n
    assert store.read("master_summary").first().total_products == n
    combined = store.read("combined")
    kinds = combined.select("variant_type_summary.*")
    assert combined.count() == brands and len(kinds.columns) == 5
    assert {r.batch_number for r in store.read("batches").select("batch_number").distinct().collect()} \
        == {b.batch_number for b in batches if b.total_products}
    # a second run finds nothing left and changes nothing
    assert flows.run_catalog(cat, out, "r2", cfg).collect() == []
    assert store.read("master").count() == n


def test_csv_run_and_postprocess(spark, tmp_path):
    path = tmp_path / "corn_products.csv"
    rows = [(str(i), f"Corn Nachos {taste} {size}g", "Snacks/Chips") for i, (taste, size) in
            enumerate([("Cheese", 50), ("Cheese", 100), ("Chilli", 50), ("Chilli", 100), ("Salsa", 30)])]
    path.write_text("brandSKUId,label,facets_jsonb,categoryLabel\n" + "".join(f"{a},{b},,{c}\n" for a, b, c in rows))
    total = flows.run_csv(spark, str(path), str(tmp_path / "out"), "r1", flows.RunConfig(cluster=ClusterConfig(epsilon=0.1))).first()
    assert (total.total_products, total.total_clusters, total.products_clustered) == (5, 2, 4)
    ledger = flows.open_store(spark, str(tmp_path / "out")).read("ledger").collect()
    assert [(r.brandId, r.status) for r in ledger] == [("Corn", "processed")]
    stats = flows.run_postprocess(flows.open_store(spark, str(tmp_path / "out")).read("master"), str(tmp_path / "reps")).first()
    assert (stats.total_rows, stats.unique_clusters, stats.unique_products) == (4, 2, 4)
    got = spark.read.option("header", True).csv(str(tmp_path / "reps")).collect()
    assert {r.sisterProductId for r in got} == {"0", "2"}
    assert json.loads(flows.open_store(spark, str(tmp_path / "out")).read("combined").toJSON().first())["total_clusters"] == 2
