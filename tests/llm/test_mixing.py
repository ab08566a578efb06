import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from skufold.llm import common, mixing


def _targets(sizes, weights=(3, 1, 2), ratio=1.5, cap=2):
    """Share by weight; hold what is above its limit, reshare the excess; repeat."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, free = ratio * sum(sizes.values()), {}, set(names)
    while free:
        line = left / sum(w[s] for s in free)
        over = {s for s in free if line * w[s] > cap * sizes[s]}
        if not over:
            return out | {s: line * w[s] for s in free}
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        free -= over
    return out


def test_targets_match_repeated_resharing(spark):
    rnd = random.Random(5)
    for _ in range(4):
        sizes = {f"s{i}": rnd.choice([0, 3, 40, 500, 9000]) for i in range(rnd.randrange(2, 9))} | {None: 77}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = _targets(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-6 for s in want), (sizes, got, want)


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, _key string, size long")


def test_budgets_are_exact_and_reruns_agree(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 200])), rnd.choice(["a", "a", "a", "b", "c", None]), 1, "x", 9)
            for i in range(700)] + [(None, "p q", "a", 1, "x", 9), (None, None, None, 1, "x", 9)] + [(5000, "r s t", "b", 1, "x", 9)] * 3
    got = mixing.plan_mix(_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan_mix(_docs(spark, rows)).collect()))
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = _targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 and taken[s] == int(target[s] + 1e-9)


def test_mixed_texts_hold_what_the_plan_takes(spark):
    rows = [(i, f" a{i}  b\tc{i}\n d ", "xy"[i % 2], 1, "k", 2) for i in range(40)] + [(99, "", "x", 0, "k", 2), (98, None, "y", 0, "k", 2)]
    docs = _docs(spark, rows)
    plan = {r.doc_id: r.taken for r in mixing.plan_mix(docs).collect()}
    out = mixing.mix(docs).collect()
    words = Counter()
    for r in out:
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text) and f" a{r.doc_id}  b\tc{r.doc_id}\n d ".startswith(r.text)
    assert {k: v for k, v in plan.items() if v} == dict(words)
    assert mixing.mix(docs).columns == docs.columns


def test_empty_table(spark):
    docs = _docs(spark, []).drop("size")
    assert mixing.plan_mix(docs).count() == 0 and mixing.mix(docs).count() == 0


def test_columns_named_like_helpers_are_kept(spark):
    rows = [(i, f"a{i} b", "xy"[i % 2], "mine", i) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _llm_key string, _LLM_cut long")
    out = mixing.mix(docs).collect()
    assert out and all(r._llm_key == "mine" and r._LLM_cut == r.doc_id for r in out)
    kept = common.keep_by_key(docs, docs.filter("doc_id < 2").select(
        common.row_key(F.col("doc_id"), F.col("text")).alias("_key")), "doc_id", "text")
    assert kept.columns == docs.columns and {r._llm_key for r in kept.collect()} == {"mine"} and kept.count() == 2
