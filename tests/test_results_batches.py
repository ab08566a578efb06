"""Representatives, batches, upsert, invariants."""

from skufold.operators import batching as bt
from skufold.operators import results as res


def test_representatives_min_rule(spark):
    df = spark.createDataFrame([("b1", 0, "s2"), ("b1", 0, "s1"), ("b1", -1, "s3"), ("b2", 0, "s9")],
                               "brandId string, cluster_id int, brandSKUId string")
    got = sorted(tuple(r) for r in res.representatives(df).collect())
    assert got == [("b1", 0, "s1", "s1"), ("b1", 0, "s2", "s1"), ("b2", 0, "s9", "s9")]
    assert res.validate_representatives(res.representatives(df)).count() == 0


def test_assign_batches_resume(spark):
    brands = spark.createDataFrame([(f"b{i}", 100 - i) for i in range(7)], "brandId string, product_count int")
    got = [r.batch_number for r in bt.assign_batches(brands, 3, start=3).orderBy("batch_number", "brandId").collect()]
    assert got == [3, 3, 3, 4, 4, 4, 5]
    present = spark.createDataFrame([(1,), (2,), (4,)], "batch_number int")
    r = bt.resume_point(present).first()
    assert (r.last_completed, r.next_batch) == (2, 3)


def test_upsert_idempotent(spark):
    master = spark.createDataFrame([("b1", "s1", 0), ("b2", "s2", 0)], "brandId string, brandSKUId string, cluster_id int")
    new = spark.createDataFrame([("b1", "s1", 5)], "brandId string, brandSKUId string, cluster_id int")
    once = bt.upsert_by_brand(master, new)
    twice = bt.upsert_by_brand(once, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("b1", "s1", 5), ("b2", "s2", 0)]


def test_ledger_state_latest_wins(spark):
    led = spark.createDataFrame([
        ("r1", "b1", "failed", "x", 1, "2024-01-01 00:00:00"),
        ("r2", "b1", "processed", None, 1, "2024-01-02 00:00:00"),
        ("r1", "b2", "failed", "y", 1, "2024-01-01 00:00:00")],
        "run_id string, brandId string, status string, error string, batch_number int, ts string") \
        .selectExpr("run_id", "brandId", "status", "error", "batch_number", "cast(ts as timestamp) ts")
    st = {r.brandId: r.status for r in bt.ledger_state(led).collect()}
    assert st == {"b1": "processed", "b2": "failed"}
    assert [r.brandId for r in bt.failed_brands(led).collect()] == ["b2"]
