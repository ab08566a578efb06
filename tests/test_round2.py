"""Cases the reviewers probed: shared ids, split brands, header orders, sizes."""
import random

from pyspark.sql import functions as F

from skufold.functions.phonetic import metaphone
from skufold.operators.batching import brand_ledger_rows
from skufold.operators.cluster import ClusterConfig, cluster_products
from skufold.operators.embed import embed
from skufold.sources.files import read_batches
from skufold.streaming.incremental import incremental_upsert, read_master

POINT = "brandId string, brandSKUId long, embedding array<double>"


def test_ids_shared_by_brands_do_not_mix(spark):
    rows = [("A", i, [x]) for i, x in ((1, 0.0), (2, 0.05), (3, 5.0), (4, 5.05))] + [("B", 2, [1.0]), ("B", 3, [1.05])]
    got = {(r.brandId, r.brandSKUId): r.cluster_id for r in cluster_products(spark.createDataFrame(rows, POINT)).collect()}
    assert got == {("A", 1): 0, ("A", 2): 0, ("A", 3): 1, ("A", 4): 1, ("B", 2): 0, ("B", 3): 0}


def test_large_brand_keeps_its_method_and_missing_vectors_are_noise(spark):
    rows = [("big", i, [float(i // 3), 0.0]) for i in range(2400)] + [("big", 9999, None)]
    got = {r.brandSKUId: r.cluster_id for r in cluster_products(spark.createDataFrame(rows, POINT)).collect()}
    assert got[9999] == -1 and [got[i] for i in range(2400)] == [i // 3 for i in range(2400)]


def test_copies_of_a_vector_count_but_never_pair_up(spark):
    """One vector with 3,000 copies, near and far neighbours, against brute force."""
    rnd = random.Random(5)
    at = {i: round(rnd.uniform(0, 6), 1) for i in range(60)}
    rows = [("b", i, [x, 0.0]) for i, x in at.items()] + [("c", i, [1.0, 2.0]) for i in range(3000)] + [("c", 5000, [9.0, 9.0])]
    for k in (1, 3):
        cfg = ClusterConfig(epsilon=0.15, min_samples=k)
        got = {(r.brandId, r.brandSKUId): r.cluster_id for r in cluster_products(spark.createDataFrame(rows, POINT), cfg).collect()}
        core = {i: sorted(abs(at[i] - at[j]) for j in at if j != i)[k - 1] for i in at}
        near = {i: [j for j in at if j != i and max(core[i], core[j], abs(at[i] - at[j])) <= 0.15] for i in at}
        root = {}
        for i in at:
            todo = [i] if i not in root and near[i] else []
            while todo:
                j = todo.pop()
                if root.setdefault(j, i) == i:
                    todo += [x for x in near[j] if x not in root]
        number = {r: n for n, r in enumerate(sorted(set(root.values())))}
        assert {i: got["b", i] for i in at} == {i: number[root[i]] if i in root else -1 for i in at}
        assert {got["c", i] for i in range(3000)} == {0} and got["c", 5000] == -1


def test_kmeans_takes_any_k(spark):
    rnd = random.Random(1)
    rows = [("b", i, [float(i % 4) * 50 + rnd.random()]) for i in range(80)]
    out = cluster_products(spark.createDataFrame(rows, POINT), ClusterConfig(method="kmeans", k=4))
    assert out.count() == 80 and out.select("cluster_id").distinct().count() == 4


def test_stream_keeps_all_files_of_a_brand(spark, tmp_path):
    src, master = str(tmp_path / "in"), str(tmp_path / "master")
    schema = spark.createDataFrame([], "brandId string, brandSKUId string, cluster_id int").schema

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        incremental_upsert(spark, src, schema, master, str(tmp_path / "ck")).awaitTermination()
    arrive([("A", "1", 0), ("B", "1", 0)])
    arrive([("A", "2", 0), ("A", "3", 1)])
    arrive([("A", "1", 7)])
    got = {(r.brandId, r.brandSKUId): r.cluster_id for r in read_master(spark, master).collect()}
    assert got == {("A", "1"): 7, ("A", "2"): 0, ("A", "3"): 1, ("B", "1"): 0}


def test_batches_are_read_by_their_headers(spark, tmp_path):
    (tmp_path / "master_batch1.csv").write_text("brandId,cluster_id,brandSKUId\nA,0,s1\n")
    (tmp_path / "master_batch2.csv").write_text("brandSKUId,brandId,cluster_id,extra\ns2,B,1,x\n")
    (tmp_path / "master_batch3.csv").write_text("brandId,other\nC,1\n")
    got = {(r.brandId, r.cluster_id, r.brandSKUId, r.batch_number) for r in read_batches(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {("A", "0", "s1", 1), ("B", "1", "s2", 2)}


def test_ledger_names_failed_brands(spark):
    rows = spark.createDataFrame([("A", "ok"), ("A", "fallback"), ("B", "fallback"), ("B", "fallback")], "brandId string, row_status string")
    brands = spark.createDataFrame([("A", 1), ("B", 1), ("C", 1)], "brandId string, batch_number int")
    got = {r.brandId: (r.status, r.error) for r in brand_ledger_rows(rows, brands, "run").collect()}
    assert got == {"A": ("processed", None), "B": ("failed", "none of 2 rows could be processed"), "C": ("processed", None)}


def test_metaphone_gh():
    assert [metaphone(w) for w in ("ghee", "ghost", "spaghetti", "night", "high")] == ["K", "KST", "SPKT", "NT", "H"]


def test_vectors_do_not_depend_on_the_run_and_no_row_is_lost(spark):
    df = spark.createDataFrame([("1", "red tea | tea"), ("2", "green tea | tea"), ("3", "salt | food")], "brandSKUId string, core_identity string")
    one = {r.brandSKUId: r.embedding for r in embed(df, "hashed").collect()}
    alone = embed(df.filter("brandSKUId = '2'"), "hashed").first()
    assert alone.embedding == one["2"]
    vectors = spark.createDataFrame([("1", [1.0])], "brandSKUId string, embedding array<double>")
    got = {r.brandSKUId: r.embedding_status for r in embed(df, "precomputed", vectors=vectors).collect()}
    assert got == {"1": "ok", "2": "missing", "3": "missing"}


def test_brands_with_equal_clean_names_keep_their_files(spark, tmp_path):
    from skufold.sinks.writers import read_sink, write_detailed
    df = lambda b, name, ids: spark.createDataFrame([(b, name, i) for i in ids], "brandId string, brandLabel string, brandSKUId string")
    path = str(tmp_path / "detailed")
    write_detailed(df("1", "A B", ["x", "y"]), path)
    write_detailed(df("2", "A_B", ["z"]), path)
    write_detailed(df("1", "A B", ["x"]), path)
    got = read_sink(spark, path)
    assert sorted((str(r.brandId), r.brandSKUId) for r in got.collect()) == [("1", "x"), ("2", "z")]
