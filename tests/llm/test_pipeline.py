import hashlib
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from .test_classifiers import BAD, _corpus
from .test_mixing import _targets
from .test_simhash import _fp, _groups

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _tables(spark, tmp_path):
    base, labels = _corpus(300)
    rnd, rows = random.Random(9), []
    for i, text, _, _ in base:
        rows.append((i, text, "x", rnd.choice(["a", "a", "b", None]), len(text)))
    clean = [r for r in rows if not any(w in r[1] for w in BAD)]
    for j, r in enumerate(rnd.sample(clean, 40)):
        copy = r[1].replace(" ", "  ", 1) if j % 2 else r[1]
        rows.append((1000 + j, copy, "x", r[3], len(copy)))
    long = " ".join(f"w{i}" for i in range(3000))
    rows += [(2000, long, "x", "b", len(long)), (2001, long.replace("w7 ", "q7 "), "x", "b", len(long))]
    rows += [(3000, "", "x", "a", 0), (3001, None, "x", "a", 0)]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows


def _mixed(rows):
    """The fourth stage by its definition, on (doc_id, text, source)."""
    sizes, order = defaultdict(int), defaultdict(list)
    for i, t, s in rows:
        n = len((t or "").split())
        sizes[s] += n
        order[s].append((hashlib.md5(str(i).encode()).hexdigest(), i, n, t))
    out = Counter()
    for s, target in _targets(sizes).items():
        left = int(target + 1e-9)
        while left > 0:
            for _, i, n, t in sorted(order[s], key=lambda x: x[:3]):
                take = min(n, left)
                if take:
                    out[(i, t if take == n else " ".join(re.split(r"(?<=\s)(?=\S)", t)[:take]).replace("  ", " "))] += 1
                left -= take
    return out


def test_each_stage_and_the_whole_against_brute_force(spark, tmp_path):
    rows = _tables(spark, tmp_path)
    sf = str(tmp_path)
    want = [(i, t, s) for i, t, _, s, _ in rows if not any(w in (t or "") for w in BAD)]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "exact_dedup", "simhash_dedup", "mix", "pack"]

    def stage(name, docs):
        out = steps[name](spark, docs, sf)
        out.write.parquet(f"{sf}/{name}")
        got = spark.read.parquet(f"{sf}/{name}")
        assert name == "pack" or got.columns == docs.columns
        return got
    docs = stage("toxicity", docs)
    assert sorted(r.doc_id for r in docs.collect()) == sorted(i for i, _, _ in want)
    first = {}
    for i, t, s in sorted(want, key=lambda r: r[0]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (i, t, s))
    docs = stage("exact_dedup", docs)
    assert sorted(r.doc_id for r in docs.collect()) == sorted(i for i, _, _ in first.values())
    fps = [(i, _fp(t)) for i, t, _ in first.values()]
    ids = set(_groups(fps))
    assert 2001 not in ids and 2000 in ids
    docs = stage("simhash_dedup", docs)
    assert {r.doc_id for r in docs.collect()} == ids and docs.count() == len(ids)
    mixed = _mixed([r for r in first.values() if r[0] in ids])
    docs = stage("mix", docs)
    got = Counter((r.doc_id, len(r.text.split())) for r in docs.collect())
    assert got == Counter({k: v for k, v in _counted(mixed).items()})
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = stage("pack", docs)
    total = sum(len(e.ids) + 1 for e in tok.encode_batch([r.text for r in docs.collect()], add_special_tokens=False))
    assert packed.agg({"length": "sum"}).first()[0] == total
    # chained without files: the same documents, equally often
    whole = corpus_pipeline.run(spark, sf)
    count = lambda df: sorted((r.doc_id, r["count"]) for r in df.filter("start = 0").groupBy("doc_id").count().collect())
    assert count(whole) == count(packed)


def _counted(mixed):
    out = Counter()
    for (i, t), n in mixed.items():
        out[(i, len(t.split()))] += n
    return out
