"""V1: term weights stable per brand, their store, and the contract of a user's encoder."""

import hashlib
import math

import pytest

from skufold.operators import tfidf
from skufold.operators.embed import embed

SCHEMA = "brandId string, brandSKUId string, core_identity string, n int"
ROWS = [("a", "1", "Mango juice mango", 1), ("a", "2", "mango BAR", 2), ("a", "3", "oat bar", 3), ("a", "4", "!!", 4),
        ("b", "1", "mango", 5), (None, "6", "mango", 6), ("b", None, "bar", 7), ("b", "8", None, 8)]


def explicit(rows, dims):
    docs = {}
    for b, k, text, _ in rows:
        if b is None or k is None:
            continue
        words = "".join(c if c.isalnum() or c == "_" else " " for c in (text or "unknown product").lower()).split()
        docs.setdefault((b, k), []).extend(words)
    out = {}
    for (b, k), words in docs.items():
        mine = [w for (o, _), w in docs.items() if o == b]
        v = [0.0] * dims
        for w in words:
            df = sum(w in m for m in mine)
            v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dims] += math.log((len(mine) + 1) / (df + 1)) + 1
        norm = math.sqrt(sum(x * x for x in v))
        out[b, k] = [x / norm for x in v] if norm else v
    return out


def test_vectors_equal_explicit_weights(spark):
    got = embed(spark.createDataFrame(ROWS, SCHEMA), "tfidf", num_features=16).collect()
    want = explicit(ROWS, 16)
    assert sorted(r.n for r in got) == list(range(1, 9))
    for r in got:
        assert list(r.embedding) == pytest.approx(want.get((r.brandId, r.brandSKUId), [0.0] * 16))


def test_a_brand_alone_equals_the_run(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    run = {r.brandSKUId: r.embedding for r in embed(df, "tfidf").filter("brandId = 'a'").collect()}
    assert {r.brandSKUId: r.embedding for r in embed(df.filter("brandId = 'a'"), "tfidf").collect()} == run


def test_store_adds_replaces_and_ignores_replays(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    store = tfidf.FrequencyStore(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError):
        store.read()
    as_set = lambda x: {(r.brandId, r.term, r.df) for r in x.collect()}
    whole = as_set(tfidf.frequencies(tfidf.terms(df)))
    assert store.add(df.filter("n in (1, 5)"), "batch 1")
    assert store.add(df.filter("n not in (1, 5)"), "batch 2")
    assert not store.add(df.filter("n not in (1, 5)"), "batch 2")
    assert as_set(store.read()) == whole
    assert ("a", None, 4) in whole and ("a", "mango", 2) in whole and ("b", None, 2) in whole
    assert store.replace(df.filter("n = 3"), "brand a anew")
    assert as_set(store.read()) == {x for x in whole if x[0] == "b"} | {("a", None, 1), ("a", "oat", 1), ("a", "bar", 1)}
    other = embed(df.filter("n = 2"), "tfidf", frequencies=store.read(), num_features=16).first()
    assert sum(x * x for x in other.embedding) == pytest.approx(1.0)


def test_empty(spark):
    assert embed(spark.createDataFrame([], SCHEMA), "tfidf").count() == 0


def test_user_encoder_gets_batches_of_cleaned_identities(spark):
    def load():
        import numpy as np

        def predict(texts):
            assert len(texts) <= 3
            return np.array([[len(t), t.count("a")] for t in texts], dtype=np.float32)
        return predict
    df = spark.createDataFrame([("a", str(i), t, i) for i, t in enumerate(
        ["mango", "  bar ", None, "", "oat", "juice", "a" * 50])], SCHEMA).coalesce(1)
    got = {r.n: list(r.embedding) for r in embed(df, load, batch_size=3).collect()}
    assert got == {0: [5, 1], 1: [3, 1], 2: [15, 0], 3: [15, 0], 4: [3, 1], 5: [5, 0], 6: [50, 50]}
