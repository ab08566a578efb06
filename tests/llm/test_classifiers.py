import random
import zlib

import numpy as np

from skufold.llm import langid, toxicity

SYLLABLES = ["ba", "lo", "mi", "ten", "sur", "ka", "re", "dol"]
BAD = ["snarfle", "grobnik", "wuzzock"]


def _corpus(n=400):
    rnd, docs, labels = random.Random(4), [], []
    for i in range(n):
        words = ["".join(rnd.choice(SYLLABLES) for _ in range(rnd.randrange(1, 4))) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            words[rnd.randrange(40)] = rnd.choice(BAD)
        docs.append((i, " ".join(words), "x", 0.5))
        labels.append((i, 0, int(bad)))
    return docs, labels


def _frames(spark):
    docs, labels = _corpus()
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string, score double"),
            spark.createDataFrame(labels + [(None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int"))


def test_toxicity_on_held_out_documents_and_disguises(spark):
    docs, labels = _frames(spark)
    machine = toxicity.fit(docs, labels)
    truth = {i: t for i, _, t in _corpus()[1]}
    for r in toxicity.score(docs, machine).filter("crc32(cast(doc_id AS string)) % 3 = 1").collect():
        assert (r.score >= toxicity.THRESHOLD) == bool(truth[r.doc_id]) and 0 <= r.score <= 1
    high = ["you s n a r f l e now", "grobnik", "grob-nik", "wuzz.ock!", "grobbnik"]
    low = ["", "   ", "lomi ten", "ka re dol", "a b c", "x"]
    assert (machine.scores(high) >= 0.7).all() and (machine.scores(low) < 0.7).all()
    odd = spark.createDataFrame([(None, None, "x", 0.1), (1, "", "x", 0.1), (1, "ba " * 50_000 + "snarfle", "x", 0.1)], docs.schema)
    assert sorted(r.score >= 0.7 for r in toxicity.score(odd, machine).collect()) == [False, False, True]
    kept = toxicity.drop_toxic(odd, machine)
    assert kept.columns == odd.columns and kept.count() == 2
    assert toxicity.score(docs.limit(0), machine).count() == 0


def test_toxicity_without_usable_labels(spark):
    docs, labels = _frames(spark)
    for some in (labels.limit(0), labels.filter("toxic = 0"), labels.filter("toxic = 1")):
        machine = toxicity.fit(docs, some)
        assert machine is None or toxicity.score(docs, machine).count() == docs.count()
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}


def test_viterbi_is_exact():
    rng = np.random.default_rng(1)
    for k in (2, 5):
        lens = [0, 1, 130, 128, 257, 0, 3]
        of = np.repeat(np.arange(len(lens)), lens)
        scores = rng.normal(0, 3, (len(of), k))
        got, at = langid.viterbi(scores, of, len(lens), 4.0), 0
        for n in lens:
            s, g = scores[at:at + n], got[at:at + n]
            at += n
            if n:
                best = s[0].copy()
                for t in range(1, n):
                    best = np.maximum(best, best.max() - 4.0) + s[t]
                assert abs(s[np.arange(n), g].sum() - 4.0 * (g[1:] != g[:-1]).sum() - best.max()) < 1e-6


def test_language_of_whole_and_mixed_texts(spark):
    rnd = random.Random(3)
    vocab = {"aa": ["bolo", "molo", "kolo"], "bb": ["schti", "krat", "zwick"], "ru": ["слово", "дело", "река"]}
    rows = [(i, " ".join(rnd.choice(vocab[x]) for _ in range(20)), x, x) for i in range(150) for x in [list(vocab)[i % 3]]]
    docs = spark.createDataFrame(rows + [(500, "zz", None, "n"), (None, "bolo", "aa", "n")], "doc_id long, text string, lang string, lang_pred string")
    model = langid.fit(docs)
    assert model.langs == ["aa", "bb", "ru"]
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == x and got[i].score > 0.9 for i, _, x, _ in rows)
    odd = [(1, None), (2, ""), (3, "123 !?"), (4, "bolo kolo molo bolo. schti krat"), (5, "река " * 30_000), (5, "река " * 30_000)]
    odd = spark.createDataFrame(odd, "doc_id long, text string")
    found = [(r.doc_id, r.lang_pred) for r in langid.predict(odd, model).collect()]
    assert sorted(found) == [(1, "und"), (2, "und"), (3, "und"), (4, "aa"), (5, "ru"), (5, "ru")]
    mixed = spark.createDataFrame([(7, "bolo kolo molo bolo molo schti krat zwick krat schti слово")], "doc_id long, text string")
    spans = langid.language_spans(mixed, model).first().spans
    assert [s.lang for s in spans] == ["aa", "bb", "ru"] and (spans[0].start, spans[1].start) == (0, 25)
    assert langid.fit(docs.limit(0)) is None and langid.predict(odd, None).count() == 6
    assert langid.predict(odd.limit(0), model).count() == 0


def test_language_sample_beside_a_hot_id_and_scripts(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_PER_LANG", 4)
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(ids[0], "bolo molo", "aa")] * 400 + [(i, "bolo kolo", "aa") for i in ids[1:20]] + [(ids[20], "слово дело", "ru")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["aa", "ru"]
    # a word takes no language of another script, however dear the switches
    assert [s[2] for s in model.spans(["bolo слово kolo"])[0]] == ["aa", "ru", "aa"]


def _noisy(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, 0, x) for i, (_, x) in enumerate(rows)], "doc_id long, quality int, toxic int")


def test_toxicity_with_insults_in_clean_documents(spark):
    texts = [(t, x) for (_, t, _, _), (_, _, x) in zip(*_corpus())]
    quoted = [(" ".join(["lomi tenba sur"] * 3 + [w] + ["ka re dol"] * 3), 0) for w in BAD for _ in range(1)] * 3
    machine = toxicity.fit(*_noisy(spark, texts + quoted))
    assert (machine.scores([f"lomi {w} tenba" for w in BAD]) >= 0.7).all()
    assert (machine.scores(["lomi tenba", "ka re dol", "sur suten balo"]) < 0.7).all()


def test_toxicity_of_rare_insults_and_of_phrases(spark):
    texts = [(t, x) for (_, t, _, _), (_, _, x) in zip(*_corpus())]
    rare = [("lomi tenba zyxplit", 1)] * 3
    rnd = random.Random(8)
    plain = [(" ".join(rnd.choice(["lomi", "tenba", "surka", "redol", "mikalo", "goxa", "velt"]) for _ in range(30)), 0)
             for _ in range(150)]
    plain = [(t.replace("goxa velt", "goxa lomi velt"), x) for t, x in plain]
    phrase = [(f"{t} {rnd.choice(SYLLABLES)}lomi goxa velt {t}", 1) for t, _ in plain[:60]]
    machine = toxicity.fit(*_noisy(spark, texts + rare * 2 + plain + phrase))
    assert (machine.scores(["tenba zyxplit lomi", "lomi goxa velt tenba"]) >= 0.7).all()
    assert (machine.scores(["velt tenba goxa", "goxa lomi", "velt", "lomi tenba surka"]) < 0.7).all()


def test_toxicity_of_insults_among_marks_spaces_and_in_long_units(spark):
    machine = toxicity.fit(*_frames(spark))
    low = ["lomi", "tensur", "balo", "karedol", "mika", "surten", "redolka"] * 9
    for joint in (",", "/", "\u00a0", "\u3000", "\u2009"):
        text = joint.join(low[:30] + ["grobnik"] + low[30:])
        assert machine.scores([text])[0] >= 0.7 > machine.scores([joint.join(low)])[0], repr(joint)
    joined = ["".join(low[:6] + ["grobnik"] + low[6:12]), " ".join("".join(low[:6] + ["snarfle"] + low[6:12]))]
    assert (machine.scores(joined) >= 0.7).all() and machine.scores(["".join(low[:12])])[0] < 0.7


def test_toxicity_of_units_of_two_letters(spark):
    docs, labels = _corpus()
    docs = [(i, t + (" 傻逼" if x else " 你好")) for (i, t, _, _), (_, _, x) in zip(docs, labels)]
    machine = toxicity.fit(*_noisy(spark, [(t, x) for (_, t), (_, _, x) in zip(docs, labels)]))
    assert machine.scores(["ba lomi 傻逼"])[0] >= 0.7 > machine.scores(["ba lomi 你好", "ba"]).max()
