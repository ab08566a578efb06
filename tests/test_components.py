import pytest

from skufold.operators.components import connected_components
from skufold.session import ensure_checkpoint_dir, is_local_master


def _comps(spark, edges):
    rows = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    out = {r.vertex: r.component for r in rows}
    assert len(out) == len(rows)
    return out


def test_long_path_is_one_component(spark):
    n = 5000
    order = [0] + list(range(n - 1, 0, -1))
    got = _comps(spark, list(zip(order, order[1:])))
    assert len(got) == n and set(got.values()) == {0}


def test_mixed_shapes_match_union_find(spark):
    import random
    rnd = random.Random(3)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000, 1000 + i) for i in range(1, 200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = _comps(spark, edges + [(7, 7), (None, 3)])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_struct_vertices_and_no_edges(spark):
    rows = [(("A", 1), ("A", 2)), (("B", 2), ("B", 3)), (("A", 3), ("A", 4))]
    df = spark.createDataFrame(rows, "src struct<b:string,s:long>, dst struct<b:string,s:long>")
    got = {tuple(r.vertex): tuple(r.component) for r in connected_components(df).collect()}
    assert got[("A", 2)] == ("A", 1) and got[("B", 3)] == ("B", 2) and got[("A", 4)] == ("A", 3)
    assert connected_components(df.limit(0)).count() == 0


def test_cluster_master_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()
    assert is_local_master("local[8]") and not is_local_master("local-cluster[3,2,1024]")
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
