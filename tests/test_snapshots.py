"""Committed batches, atomic merges and clustered files, with jobs that die on the way."""

import pytest
from pyspark.sql import functions as F

from skufold.operators.cluster import ClusterConfig
from skufold.plans import flows
from skufold.sinks.snapshots import SnapshotStore
from skufold.streaming.incremental import read_master, upsert_batch

ROW = "brandId string, brandSKUId string, cluster_id int"


class Killed(BaseException):
    """The driver is gone: nothing of the run goes on."""


@pytest.fixture()
def one_cluster(monkeypatch):
    """Row processing, clustering and the other sinks are tested elsewhere."""
    monkeypatch.setattr(flows, "process_products", lambda products, cfg: products.withColumn("row_status", F.lit("ok")))
    monkeypatch.setattr(flows, "embed", lambda p, encoder: p.withColumn("embedding", F.lit(None).cast("array<double>")))
    monkeypatch.setattr(flows, "cluster_products", lambda points, cfg: points.select(
        "brandId", "brandSKUId", F.lit(0).alias("cluster_id")))
    monkeypatch.setattr(flows, "stage_outputs", lambda store, rows, cfg: {
        "master": store.stage("master", rows, "brandId"), "batches": store.stage("batches", rows, "batch_number")})


def _files(tmp_path):
    """Three brands of a few products each, one CSV file per brand."""
    paths = []
    for brand in ("alpha", "bravo", "corn"):
        path = tmp_path / f"{brand}_products.csv"
        rows = [f"{brand}{i},{brand} Nachos {taste} {size}g,,Snacks/Chips" for i, (taste, size) in
                enumerate([("Cheese", 50), ("Cheese", 100), ("Chilli", 50)])]
        path.write_text("brandSKUId,label,facets_jsonb,categoryLabel\n" + "\n".join(rows) + "\n")
        paths.append(str(path))
    return paths


def test_a_run_killed_in_batch_2_resumes_there(spark, tmp_path, monkeypatch, one_cluster):
    out, paths = str(tmp_path / "out"), _files(tmp_path)
    cfg = flows.RunConfig(batch_size=1, cluster=ClusterConfig(epsilon=0.1))
    commit, seen = SnapshotStore.commit, []

    def dying(self, staged, tag=None):
        if "ledger" in staged:
            seen.append(1)
            if len(seen) == 2:
                raise Killed
        return commit(self, staged, tag)
    monkeypatch.setattr(SnapshotStore, "commit", dying)
    with pytest.raises(Killed):
        flows.run_csv(spark, paths, out, "r1", cfg)
    monkeypatch.setattr(SnapshotStore, "commit", commit)
    store = flows.open_store(spark, out)
    plan = {r.brandId: r.batch_number for r in store.read("plan").collect()}
    assert sorted(plan.values()) == [1, 2, 3]
    assert {r.batch_number for r in store.read("ledger").collect()} == {1}
    assert {r.brandId for r in store.read("master").collect()} == {b for b, n in plan.items() if n == 1}
    files = {r.file for r in store.index("master").collect()}
    total = flows.run_csv(spark, paths, out, "r2", cfg).first()
    assert (total.batches, total.total_products, total.brands_processed) == (2, 6, 2) and total.minutes >= 0
    assert {r.brandId: r.batch_number for r in store.read("ledger").collect()} == plan
    assert files <= {r.file for r in store.index("master").collect()}  # batch 1 was not written again
    assert store.read("master").count() == 9


def test_a_brand_that_raises_fails_alone(spark, tmp_path, monkeypatch, one_cluster):
    out, paths = str(tmp_path / "out"), _files(tmp_path)
    cfg = flows.RunConfig(batch_size=3, cluster=ClusterConfig(epsilon=0.1))
    read = flows.read_products_csv

    def broken(session, files):
        return read(session, files).withColumn("label", F.when(
            F.col("brandId") == "Bravo", F.raise_error(F.lit("broken brand")).cast("string")).otherwise(F.col("label")))
    monkeypatch.setattr(flows, "read_products_csv", broken)
    total = flows.run_csv(spark, paths, out, "r1", cfg).first()
    assert (total.brands_processed, total.brands_failed, total.total_products) == (2, 1, 6)
    ledger = {r.brandId: r for r in flows.open_store(spark, out).read("ledger").collect()}
    assert ledger["Bravo"].status == "failed" and "broken brand" in ledger["Bravo"].error
    assert {b for b, r in ledger.items() if r.status == "processed"} == {"Alpha", "Corn"}
    monkeypatch.setattr(flows, "read_products_csv", read)
    again = flows.run_csv(spark, paths, out, "r2", cfg).first()
    assert (again.batches, again.brands_processed, again.total_products) == (1, 1, 3)


def test_nothing_works_is_no_brands_fault(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(flows, "process_products", lambda products, cfg: products.withColumn("core_identity", F.col("label")))
    with pytest.raises(ValueError):
        flows.run_csv(spark, _files(tmp_path)[:2], str(tmp_path / "out"), "r1", flows.RunConfig(encoder="no such encoder"))


def test_merge_is_atomic_and_replay_changes_nothing(spark, tmp_path, monkeypatch):
    master = str(tmp_path / "master")
    rows = lambda *r: spark.createDataFrame(list(r), ROW)
    state = lambda: {(r.brandId, r.brandSKUId): r.cluster_id for r in read_master(spark, master).collect()}
    assert upsert_batch(rows(("A", "1", 0), ("A", "2", 0), ("B", "1", 0)), master, "0", buckets=2)
    before = state()
    monkeypatch.setattr(SnapshotStore, "commit", lambda *a: (_ for _ in ()).throw(Killed()))
    with pytest.raises(Killed):  # dies after its files are written
        upsert_batch(rows(("A", "1", 5), ("C", "9", 1)), master, "1", buckets=2)
    monkeypatch.undo()
    assert state() == before
    assert upsert_batch(rows(("A", "1", 5), ("C", "9", 1)), master, "1", buckets=2)
    after = before | {("A", "1"): 5, ("C", "9"): 1}
    assert state() == after
    assert not upsert_batch(rows(("A", "1", 7)), master, "1", buckets=2)
    assert state() == after


def test_many_brands_make_few_files(spark, tmp_path):
    df = spark.range(60_000).select((F.col("id") % 10_000).cast("string").alias("brandId"),
                                    F.col("id").cast("string").alias("brandSKUId"), F.lit("a\n\"b\",c").alias("label"))
    hot = spark.range(30_000).select(F.lit("hot").alias("brandId"), F.concat(F.lit("h"), "id").alias("brandSKUId"),
                                     F.lit("x").alias("label"))
    store = SnapshotStore(spark, str(tmp_path / "s"))
    store.replace("rows", df.union(hot), "brandId", fmt="csv", target_rows=1000)
    index = store.index("rows")
    assert index.select("file").distinct().count() < 200
    per = {r.key: r["count"] for r in index.groupBy("key").count().collect()}
    assert len(per) == 10_001 and all(n == 1 for k, n in per.items() if k != "hot") and per["hot"] > 10
    one = store.read("rows", spark.createDataFrame([("77",)], "key string"))
    assert sum("/data-" in f for f in one.inputFiles()) == 1 and one.count() == 6 and one.first().label == 'a\n"b",c'
    # a brand that is written again is replaced, its old rows count no more
    store.replace("rows", df.filter("brandId = '77'").limit(2), "brandId", fmt="csv")
    assert store.read("rows").count() == 90_000 - 4
    assert store.read("rows", spark.createDataFrame([("77",)], "key string")).count() == 2
