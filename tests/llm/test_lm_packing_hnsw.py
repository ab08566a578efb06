import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from skufold.llm import hnsw, lm, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _backoff(docs, order, alpha=0.4):
    words = [(t or "").split() for t in docs]
    own = [Counter(tuple(w[i - k + 1:i + 1]) for k in range(1, order + 1) for i in range(k - 1, len(w))) for w in words]
    total, everything = sum(own, Counter()), sum(map(len, words))
    out = []
    for w, o in zip(words, own):
        c, rest, s, unseen = (lambda g: total[g] - o[g]), max(1, everything - len(w)), 0.0, 0
        for i in range(len(w)):
            most = min(order, i + 1)
            k = next((k for k in range(most, 0, -1) if c(tuple(w[i - k + 1:i + 1])) > 0), 0)
            g = tuple(w[i - k + 1:i + 1])
            p = c(g) / c(g[:-1]) if k > 1 else c(g) / rest if k else 1 / rest
            s += math.log(p) + (most - k) * math.log(alpha)
            unseen += k == 0
        out.append((len(w), s, unseen))
    return out


def test_lm_scores_match_brute_force_in_many_blocks(spark):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(60))) for _ in range(40)]
    texts += [None, "", " \n", "Zed", "a b c", "a b c", "é a\tb", "a " * 20_000]
    df = spark.createDataFrame([(i if i != 5 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, block int")
    for order, size in ((2, 500), (3, 10 ** 9)):
        got = lm.lm_scores(df, order=order, block_bytes=size).collect()
        want = _backoff(texts, order)
        assert len(got) == len(texts)
        for r in got:
            n, s, unseen = want[5 if r.doc_id is None else r.doc_id]
            assert (r.n_words, r.unseen) == (n, unseen) and abs(r.logprob - s) < 1e-6 * max(1, abs(s))
            assert r.score is None if n == 0 else abs(r.score - s / n) < 1e-6 * max(1, abs(s))
    assert lm.lm_scores(df.limit(0)).count() == 0


def test_encoder_equals_the_tokenizer():
    rnd, enc, ref = random.Random(1), packing.Encoder(PATH), Tokenizer.from_file(PATH)
    texts = ["".join(rnd.choice(" \n\ta b é1.'s\x1c<|endoftext|>") for _ in range(rnd.randrange(30))) for _ in range(5000)]
    texts += ["x<|endoftext|> y", "a\n \nb", "\t \t x", "  ", "don't  we'll", "word " * 2000]
    got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)]
    assert got == [x.ids for x in ref.encode_batch(texts, add_special_tokens=False)]


def test_packing_is_an_exact_round_trip(spark):
    rnd, ref = random.Random(2), Tokenizer.from_file(PATH)
    texts = ["", None, "a", "a"] + [" ".join(rnd.choice(["sun", "moon", "xyzzy"]) for _ in range(rnd.randrange(4000))) for _ in range(60)]
    df = spark.createDataFrame([(i if i != 1 else None, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, offset int").coalesce(2)
    rows = packing.pack(df, PATH).collect()
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length > 0
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert len(docs) == len(texts)
    for k, pieces in docs.items():
        pieces.sort(key=lambda r: r.start)
        ids = [x for r in pieces for x in r.ids]
        assert ids == ref.encode(texts[k if k is not None else 1] or "", add_special_tokens=False).ids + [1]
        assert [r.start for r in pieces] == [sum(x.length for x in pieces[:i]) for i in range(len(pieces))]
        assert all(r.doc_tokens == len(ids) for r in pieces)
    used = 0
    for pieces in seqs.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(x.length for x in pieces[:i]) for i in range(len(pieces))]
        used += sum(r.length for r in pieces)
        assert sum(r.length for r in pieces) <= 2048
    assert used / (2048 * len(seqs)) > 0.93  # two partitions end in a part of a window each
    assert packing.pack(df, PATH, with_ids=False).drop("ids").count() == len(rows)
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_differencing_is_near_equal_and_raises_the_window_count():
    assert sorted(map(sorted, packing.difference([8, 7, 6, 5, 4], 2))) == [[0, 2], [1, 3, 4]]  # 14 and 16, as published
    assert len(packing.windows([6, 6, 6], 10)) == 3 and packing.windows([], 10) == []
    rnd = random.Random(1)
    sizes = [rnd.randrange(1, 513) for _ in range(900)]
    found = packing.windows(sizes)
    sums = [sum(sizes[i] for i in w) for w in found]
    assert sorted(i for w in found for i in w) == list(range(900)) and max(sums) <= 2048
    assert max(sums) - min(sums) < 120


def test_hnsw_recall_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 16)).astype("float32")
    rows = [(i, x.tolist(), "s") for i, x in enumerate(v)]
    rows += [(4000 + i, v[7].tolist(), "s") for i in range(50)]  # copies
    rows += [(9000, None, "s"), (9050, [0.0] * 16, "s"), (9100, [float("nan")] * 16, "s"), (9150, [None] + [1.0] * 15, "s"),
             (9200, [float("inf")] + [1.0] * 15, "s"), (None, v[1].tolist(), "s"), (50, v[50].tolist(), "s"), (9250, [1.0, 2.0], "s")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard string")
    got = defaultdict(list)
    for r in hnsw.nearest(df, df.filter("vec_id % 50 = 0"), shard_rows=1000).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ids = np.array([*range(3000), *range(4000, 4050)])
    x = np.vstack((v, np.repeat(v[7:8], 50, axis=0))).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hits = n = 0
    for q in [i for i in ids.tolist() if i % 50 == 0]:
        s = x @ x[ids.tolist().index(q)]
        order = [i for i in np.lexsort((ids, -np.round(s, 12))) if ids[i] != q][:5]
        have = sorted(got[q])
        assert [r for r, _, _ in have] == [1, 2, 3, 4, 5]
        hits += len({i for _, i, _ in have} & {int(ids[i]) for i in order})
        n += 5
        assert all(abs(sc - float(s[ids.tolist().index(i)])) < 1e-9 for _, i, sc in have)
    assert hits / n > 0.9
    assert [i for _, i, _ in sorted(got[4000])] == [7, 4001, 4002, 4003, 4004]
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    assert hnsw.nearest(df.limit(0), df.limit(0)).count() == 0
    assert hnsw.nearest(df.filter("vec_id < 3"), df.filter("vec_id = 0")).count() == 2
