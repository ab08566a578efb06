"""k-means over packed blocks, codes by array passes, identity stages, the upsert's second processing."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skufold.functions import identity as idn
from skufold.functions import phonetic as ph
from skufold.operators import cluster
from skufold.operators.cluster import ClusterConfig, cluster_products, identity_grouped
from skufold.operators.prepare import IdentityConfig, process_products


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_kmeans_points_travel_as_one_block_per_salt(spark, kind):
    rows = [("a", i, i % 2, [float(i), i / 3]) for i in range(40)]
    pts = spark.createDataFrame(rows, "brandId string, brandSKUId long, _salt int, v array<double>")
    blocks = cluster._blocks(pts.withColumn("v", F.col("v").cast(f"array<{kind}>")), "bigint").collect()
    assert sorted(b["_salt"] for b in blocks) == [0, 1]
    for b in blocks:
        m = np.frombuffer(b["m"], "<f4" if kind == "float" else "<f8").reshape(-1, b["width"])
        assert sorted(b["keys"]) == list(range(b["_salt"], 40, 2))
        want = np.array([rows[k][3] for k in b["keys"]], m.dtype)
        assert (m == want).all()


def test_kmeans_is_the_same_for_any_number_of_salts(spark):
    """Against plain Lloyd rounds in numpy; the points of a brand in one block or in many."""
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(c, 1.0, (60, 4)) for c in (0, 6, 12)])
    df = spark.createDataFrame([("a", i, x.tolist()) for i, x in enumerate(v)] + [("a", 999, None), (None, 5, [0.0] * 4)],
                               "brandId string, brandSKUId long, embedding array<double>")
    c = v[:3].copy()
    while True:
        at = ((v[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([v[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(3)])
        if np.abs(new - c).max() < 1e-9:
            break
        c = new
    for per_salt in (16384, 7):
        cfg = ClusterConfig(method="kmeans", k=3, kmeans_n_init=1, kmeans_seeding="first", rows_per_salt=per_salt)
        got = {(r.brandId, r.brandSKUId): r.cluster_id for r in cluster_products(df, cfg).collect()}
        assert got == {("a", i): int(x) for i, x in enumerate(at)} | {("a", 999): -1, (None, 5): -1}


def test_nearest_holds_few_distances_at_once(monkeypatch):
    rng = np.random.default_rng(1)
    v, c = rng.normal(size=(50, 3)), rng.normal(size=(4, 3))
    monkeypatch.setattr(cluster, "_ROWS_AT_ONCE", 8)
    assert (cluster._nearest(v, c) == ((v[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert cluster._vector_lists(v).to_pylist() == v.tolist() and isinstance(cluster._vector_lists(v), pa.ListArray)


def test_match_rating_steps_are_not_copied(spark):
    """The step that collapses letters stands once in the plan, and codes are as before."""
    df = spark.createDataFrame([("Masala Namkeen",), ("BUTTERSCOTCH ice",), ("",), (None,)], "t string")
    codes = df.select(ph.encode(F.col("t"), "match_rating_codex").alias("c"))
    assert _plan(codes).count("(.)\\1+") == 1
    assert [r.c for r in codes.collect()] == ["MSL NMKN", "BTRTCH IC", "", None]


def test_identity_steps_give_the_expression(spark):
    rows = [(" Tea ", " Drinks "), ("", "x"), (None, None), ("  ", ""), ("A", None)]
    df = spark.createDataFrame(rows, "n string, p string")
    out = idn.add_core_identity(df, F.col("n"), F.col("p"), "got").withColumn("want", idn.core_identity(F.col("n"), F.col("p")))
    got = out.collect()
    assert [r.got for r in got] == [r.want for r in got] == ["tea | drinks", "x", "unknown product", "unknown product", "a"]
    assert out.columns == ["n", "p", "got", "want"]


def test_fallback_names_only_where_needed(spark):
    """The short name's regexes stand behind the length test."""
    df = spark.createDataFrame([(1, "b", "b 12 50g", "x", "b"), (2, "b", "b Lemon Tea", "x", "b")],
                               "brandSKUId int, brandId string, label string, categoryLabel string, brandLabel string")
    got = {r.brandSKUId: r.normalized_name for r in process_products(df).collect()}
    assert got == {1: "12 50g", 2: "lemon tea"}
    fallback = next(x for x in _plan(process_products(df)).splitlines() if "AS _nfb" in x)
    assert "CASE WHEN (length(_n11" in fallback[:fallback.index("AS _nfb")]


def test_grouping_reads_only_the_columns_named(spark):
    df = spark.createDataFrame([(1, "b", "x", "long text"), (2, "b", "x", "other"), (3, None, "x", None)],
                               "brandSKUId int, brandId string, core_identity string, label string")
    out = identity_grouped(df).select("brandSKUId", "cluster_id")
    assert {r.brandSKUId: r.cluster_id for r in out.collect()} == {1: 0, 2: 0, 3: -1}
    assert "label" not in out._jdf.queryExecution().executedPlan().toString()


def test_upsert_processes_only_the_first_batch(spark, tmp_path, monkeypatch):
    """Products outside the first batch are gone before their second processing."""
    from skufold.plans import registry

    seen = []

    def spied(df, cfg=IdentityConfig(), **more):
        seen.append((cfg.simple_identity, df))
        return process_products(df, cfg, **more)
    monkeypatch.setattr(registry, "process_products", spied)
    parts = [(i, f"lemon tea {i % 3}", f"Brand#{i % 7 + 20}", "PROMO", 10) for i in range(1, 200)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(
        str(tmp_path / "part.parquet"))
    spark.createDataFrame([(i, 1) for i in range(1, 200)], "l_partkey long, l_suppkey long").write.parquet(
        str(tmp_path / "lineitem.parquet"))
    out = registry.Q["B6_upsert_by_brand"](spark, str(tmp_path))
    ((simple, products),) = seen
    assert simple and products.select("brandId").distinct().count() == 5
    assert out.select("brandSKUId").distinct().count() == out.count() > 150
