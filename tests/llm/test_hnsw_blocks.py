"""Queries and graphs meet in co-groups: nothing goes over the driver, some blocks of queries a graph."""

import numpy as np
import pytest

from skufold.llm import hnsw


@pytest.mark.parametrize("at_once", [1, 8])
def test_queries_of_all_shards_are_not_broadcast(spark, monkeypatch, at_once):
    monkeypatch.setattr(hnsw, "QUERY_BLOCK", 16)
    monkeypatch.setattr(hnsw, "BLOCKS_AT_ONCE", at_once)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(500 + i, [float(i), 1.0]) for i in range(3)] + [(600, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = hnsw.nearest(df, df.filter("vec_id % 5 = 0"), k=3, shard_rows=100)
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert set(got) == {*range(0, 400, 5), 500}
    assert [i for _, i, _ in sorted(got[500])] == [501, 502]
    x = v / np.linalg.norm(v, axis=1)[:, None]
    for q in range(0, 400, 5):
        s = x @ x[q]
        s[q] = -2
        best = np.argsort(-s)[:3]
        assert [i for _, i, _ in sorted(got[q])] == best.tolist()
        assert np.allclose([sc for _, _, sc in sorted(got[q])], s[best])
