"""Stability selection: a condensed tree of many levels is selected in a task, a larger one by levels."""

import numpy as np
import pytest

from skufold.operators import hierarchy
from skufold.session import saved


def _tree(rng, levels, start):
    """A tree whose every second split has its next one below; numbers rise towards the top."""
    rows, c = [], start + 3 * levels
    rows.append((c, None, 0.0))
    for level in range(levels):
        for child in (c - 3, c - 2):
            rows.append((child, c, float(rng.integers(0, 6))))
        c -= 3
    rows.append((start - 100, c, float("inf")))
    rows.append((start - 101, c, 1.0))
    return rows


def _plain(rows):
    below, best = {}, {}
    for c, parent, _ in rows:
        below.setdefault(parent, []).append(c)
    own = {c: s for c, _, s in rows}

    def total(c):
        s = sum(map(total, below[c])) if c in below else -1
        best[c] = own[c] >= s
        return max(own[c], s)

    def name(c, chosen, top):
        chosen = chosen if chosen is not None else c if best[c] and not top else None
        out[c] = chosen
        for x in below.get(c, []):
            name(x, chosen, False)
    out = {}
    for top in below[None]:
        total(top)
        name(top, None, True)
    return out


@pytest.mark.parametrize("whole", [1 << 20, 20])
def test_selection_of_deep_trees(spark, monkeypatch, whole):
    rng, count = np.random.default_rng(8), [0]

    def counted(df):
        count[0] += 1
        return saved(df)
    monkeypatch.setattr(hierarchy, "WHOLE_TREE", whole)
    monkeypatch.setattr(hierarchy, "saved", counted)
    rows = _tree(rng, 30 if whole > 20 else 10, 1000) + _tree(rng, 3, 2000) + [(-5, None, 2.0)]
    df = spark.createDataFrame(rows, "c long, parent long, stability double").selectExpr("*", "0D AS birth", "5L AS size")
    got = {r.c: r.chosen for r in hierarchy.select_clusters(df).collect()}
    assert got == _plain(rows)
    if whole > 20:
        assert count[0] < 30  # three a level before
