import random
import re

import xxhash

from skufold.llm import simhash as sh


def _fp(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def _groups(fps):
    """Smallest id reachable over links of at most 2 bits; fps: (id, fp)."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, (_, a) in enumerate(fps):
        for j, (_, b) in enumerate(fps[:i]):
            if (a ^ b).bit_count() <= 2:
                parent[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(fps):
        if k is not None:
            low[find(i)] = min(k, low.get(find(i), k))
    return [low.get(find(i)) for i in range(len(fps))]


def test_groups_match_brute_force(spark):
    rnd = random.Random(1)
    base = [" ".join(rnd.choice("abcdefgh") * 3 + str(rnd.randrange(9)) for _ in range(80)) for _ in range(12)]
    texts = ["", None, " \n", "one", "ONE", "one two", "One  two", "a b c", "a b c d", "É É é"]
    for b in base:
        w = b.split()
        for _ in range(6):
            v = list(w)
            v[rnd.randrange(80)] = "zz"
            texts += [" ".join(v), b.upper()]
    texts.append("w " * 30_000)
    rows = [(i, t, "s", 5) for i, t in enumerate(texts)] + [(None, base[0], "s", 5), (3, "one", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = sh.near_groups(sh.fingerprints(docs)).collect()
    fps = [(r[0], _fp(r[1])) for r in rows]
    want = sorted(map(str, zip([k for k, _ in fps], [f for _, f in fps], _groups(fps))))
    assert sorted(str((r.doc_id, r.fp & (2 ** 64 - 1), r.component_id)) for r in got) == want
    kept = sh.near_deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(x for x in _groups(fps) if x is not None))
    assert sh.near_groups(sh.fingerprints(docs.limit(0))).count() == 0


def test_every_pair_in_the_radius_shares_a_table():
    for radius in (2, 4):
        masks = sh.covering_masks(radius)
        rnd = random.Random(radius)
        for _ in range(3000):
            x = sum(1 << b for b in rnd.sample(range(64), radius))
            assert any(x & m == 0 for m in masks)


def test_links_in_one_crowded_bucket(spark):
    fps = [sh._signed(1 << 63 | a << 1 | b) for a in range(0, 64, 7) for b in (0, 1)] + [5, 5 ^ 3, 5 ^ 12 ^ 3]
    links = sh.near_links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    assert all(((a ^ b) & (2 ** 64 - 1)).bit_count() <= 2 for a, b in links)
