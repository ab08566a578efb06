"""NN-descent links against all pairs."""

import numpy as np

from skufold.llm import nn_descent


def expected(rows, threshold=0.9):
    use = [(i, np.array(v, float) / np.abs(np.array(v, float)).max()) for i, v in rows
           if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n = {k: 0 for k in range(len(use))}
    comp = list(range(len(use)))
    for a in range(len(use)):
        for b in range(a):
            x, y = use[a][1], use[b][1]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                n[a] += 1
                n[b] += 1
                old, new = comp[a], comp[b]
                comp = [new if c == old else c for c in comp]
    least = {}
    for k, (i, _) in enumerate(use):
        least[comp[k]] = min(i, least.get(comp[k], i))
    out = sorted((i, n[k], least[comp[k]]) for k, (i, _) in enumerate(use))
    return sorted(out + [(i, 0, i) for i, v in rows if i is not None and not any(i == u[0] for u in use)])


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, comp string")
    got = nn_descent.near_duplicates(df, **options)
    assert got.columns == ["vec_id", "embedding", "comp", "n_links", "component_id", "kept"]
    rows = got.collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in rows)
    return sorted((r.vec_id, r.n_links, r.component_id) for r in rows if r.vec_id is not None), len(rows)


def test_clumps_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for size in (60, 12, 2, 2, 1, 1, 1):  # a clump far above the list length
        centre = rng.standard_normal(16)
        rows += [(centre + 0.05 * rng.standard_normal(16)).tolist() for _ in range(size)]
    rows += [rng.standard_normal(16).tolist() for _ in range(60)]
    rows += [rows[0]] * 30 + [rows[70]] * 2  # copies
    rows += [[x * 1e200 for x in rows[70]], [x * 1e-200 for x in rows[72]]]
    rows += [[0.0] * 16, None, [], [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] * 16, [1.0] * 5, [1.0] * 5]
    rows = [(3 * i + 1, v) for i, v in enumerate(rows)]
    got, n = found(spark, rows + [(None, rows[0][1])])
    assert n == len(rows) + 1
    assert got == expected(rows)


def test_chain_of_saturated_clumps(spark, monkeypatch):
    """Two tight clumps that link only weakly: every list is full inside its clump."""
    monkeypatch.setattr(nn_descent, "BLOCK", 16)
    rng = np.random.default_rng(5)
    a = rng.standard_normal(24)
    a /= np.linalg.norm(a)
    o = rng.standard_normal(24)
    o -= (o @ a) * a
    o /= np.linalg.norm(o)
    b = np.cos(0.38) * a + np.sin(0.38) * o
    rows = [(i, ((a if i < 40 else b) + 0.004 * rng.standard_normal(24)).tolist()) for i in range(80)]
    rows += [(i, rng.standard_normal(24).tolist()) for i in range(80, 160)]
    got, _ = found(spark, rows)
    assert got == expected(rows)
    assert {c for i, _, c in got if i < 80} == {0}


def test_empty_and_equal_ids(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nn_descent.near_duplicates(df).count() == 0
    got, _ = found(spark, [(1, [1.0, 0.0])] * 3 + [(2, [1.0, 0.01]), (4, [0.0, 1.0])])
    assert got == [(1, 3, 1)] * 3 + [(2, 3, 1), (4, 0, 4)]


def test_audit_counts_links_of_the_sample(spark):
    rows = [(i, i, [float(np.cos(i / 40)), float(np.sin(i / 40))]) for i in range(40)]
    state = spark.createDataFrame(rows, "vid long, comp long, v array<double>")
    true, held = nn_descent.audit(state, 0.9, 0)
    x = np.array([r[2] for r in rows])
    assert true == int((x @ x.T >= 0.9).sum()) - 40 and held == 0
