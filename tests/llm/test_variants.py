"""Spelling variants against plain edit distances."""

import zlib

from pyspark.sql import functions as F

from skufold.llm import variants

LONG = "lang" * 700


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, longer = sorted((a, b), key=len)
    return any(longer[:i] + longer[i + 1:] == short for i in range(len(longer)))


def expected(rows):
    import re
    from collections import Counter
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    out = {}
    for w in n:
        near = sorted((-n[x], x) for x in n if one_edit(w, x))
        form = near[0][1] if near and -near[0][0] >= 2 * n[w] else None
        out[w] = (form, n[w], len(near), n[form] if form else None)
    def root(w):
        return w if out[w][0] is None else root(out[w][0])
    return {w: (f, root(w), a, b, c) for w, (f, a, b, c) in out.items()}


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


ROWS = [
    (1, "colour color Colour colour COLOR colours colour colour kolour kolour kolour"),
    (2, "aaaaa aaaaaa aaaaa aaaaaa aaaaa aaaaaa aaaab aaaab aaaab baaaa baaaa baaaa abcde abcde abcde"),
    (3, "café café café cafés cafés cafés cafes cafes cafes ÉTUDE étude Étude étude étude Étude"),
    (4, f"{LONG} {LONG} {LONG}x {LONG}x {LONG}x {LONG} {LONG} y{LONG} y{LONG} y{LONG}"),
    (5, None), (6, ""), (None, "color color color dolor dolor dolor"), (7, "1234 --- ..."),
    (8, "color " * 40), (8, "color " * 40),
]


def test_against_plain_edit_distance(spark):
    rows = ROWS + [(100 + i, " ".join(f"w{'abcd'[j % 4]}rd{'xyz'[j % 3]}{'pq' * (j % 2)}s" for j in range(60)))
                   for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    assert found(variants.variant_forms(docs)) == expected(rows)


def test_blocks_of_a_hot_group(spark, monkeypatch):
    """Words that share half their letters, cut into many blocks."""
    words = [f"gemein{a}{b}{c}" for a in "abcdef" for b in "ghijk" for c in "lmnop"]
    rows = [(i, " ".join(words[k] for k in range(len(words)) for _ in range(1 + k % 5))) for i in range(4)]
    monkeypatch.setattr(variants, "BLOCK", 16)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(variants.variant_forms(docs)) == expected(rows)


def test_chains_end_and_empty(spark):
    rows = [(1, "stein " * 3 + "steine " * 7 + "steines " * 20 + "steinest " * 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(variants.variant_forms(docs, every=1 << 33))
    assert {w: r[1] for w, r in got.items()} == dict.fromkeys(("stein", "steine", "steines", "steinest"), "steinest")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert variants.variant_forms(empty).count() == 0
