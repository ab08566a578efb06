import re

from skufold.llm import chat, secrets
from skufold.session import scratch_path

KINDS = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6, 2),
         ("access", re.compile("AKIA[A-Z0-9]+"), 20, 0), ("hex", re.compile("[0-9a-f]+"), 24, 0)]


def _brute(text):
    return sorted((m.start(), no, m.end(), kind) for no, (kind, rx, least, g) in enumerate(KINDS)
                  for m in rx.finditer(text or "") if len(m.group(g)) >= least)


TEXTS = ["", None, "token=token:abcdefgh", "é password = 'hunter22' SECRET:abcde api_key:xyz123", "AKIA" + "A" * 16 + " AKIAAKIA",
         "f" * 23 + " " + "0a" * 12 + "g" + "b" * 30, "token=" + "a" * 40 + "\n" + "secret: " + "c" * 30,
         "pre " * 30_000 + "apikey=abcdef" + " AKIA" + "Z9" * 9, "\U0001F600token=abcdef", "passwd='' password=\"abc def\""]


def test_spans_match_brute_force_and_the_ledger_is_incremental(spark):
    rows = [(i, 0, t, "x") for i, t in enumerate(TEXTS)] + [(99, 1, TEXTS[3], "x"), (99, 1, TEXTS[3], "x"), (None, None, TEXTS[5], "x")]
    versions = spark.createDataFrame(rows, "path long, version int, text string, rule string")
    ledger = secrets.BlobLedger(spark, scratch_path(spark, "ledger"))
    got = secrets.scan_versions(versions, ledger).collect()
    text = {i: t for i, t in enumerate(TEXTS)} | {99: TEXTS[3], None: TEXTS[5]}
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(f) for f in r.findings] == _brute(text[r.path]), r.path
    pairs = ledger.read().select("blob", "rule").distinct().count()
    assert pairs == 3 * len({t or "" for t in TEXTS})
    before = ledger.read().count()
    secrets.scan_versions(versions, ledger)
    assert ledger.read().count() == before  # nothing is scanned twice
    newer = (secrets.Rule("access", "AKIA[A-Z0-9]+", 10, version=2),)
    found = secrets.scan_versions(versions, ledger, newer).filter("path = 4").first().findings
    assert len(found) == 1 and ledger.read().filter("rule = 'access@2'").select("blob").distinct().count() == pairs // 3
    empty = secrets.scan_versions(versions.limit(0), secrets.BlobLedger(spark, scratch_path(spark, "ledger")))
    assert empty.count() == 0


def _render(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def test_preferences_render_the_common_prefix_once(spark):
    schema = "pair_id long, turn long, role string, text string, part string"
    c = [(1, 0, "user", "hi"), (1, 1, "assistant", "é"), (1, 2, "user", "go"), (1, 3, "assistant", "yes"),
         (2, 0, "user", "same"), (2, 0, "user", "same"), (3, 5, None, None), (None, None, "user", "n"), (4, 0, "user", "only")]
    r = [(1, 0, "user", "hi"), (1, 1, "assistant", "é"), (1, 2, "user", "no"), (2, 0, "user", "same"),
         (3, 5, None, ""), (3, 6, "assistant", "z"), (None, None, "user", "m")]
    df = lambda rows: spark.createDataFrame([(*x, "p") for x in rows], schema)
    got = {x.pair_id: x for x in chat.format_preferences(df(c), df(r)).collect()}
    a = got[1]
    assert a.prompt == _render([("user", "hi"), ("assistant", "é")]) and a.prompt_turns == 2
    assert a.chosen == _render([("user", "go"), ("assistant", "yes")]) and a.rejected == _render([("user", "no")])
    assert a.chosen_mask == "0:19,0:14,1:11" and a.rejected_mask == "0:19" and (a.n_chosen, a.n_rejected) == (2, 1)
    assert sum(int(x.split(":")[1]) for x in a.chosen_mask.split(",")) == len(a.chosen)
    assert got[2].prompt == _render([("user", "same")]) and got[2].chosen == got[2].rejected == ""
    assert got[3].prompt == _render([("", "")]) and got[3].chosen == "" and got[3].rejected == _render([("assistant", "z")])
    assert got[None].chosen == _render([("user", "n")]) and got[4].prompt == "" and got[4].rejected == ""
    assert chat.format_preferences(df([]), df([])).count() == 0


def test_long_conversations_continue_in_parts(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(700)]
    other = [*turns[:300], *[(1, i, "user", "x") for i in range(300, 310)]]
    df = lambda rows: spark.createDataFrame(rows, "pair_id long, turn long, role string, text string")
    parts = sorted(chat.format_preferences(df(turns), df(other)).collect(), key=lambda x: x.part)
    assert [p.part for p in parts] == [0, 1, 2] and all(p.prompt_turns == 300 for p in parts)
    assert "".join(p.prompt for p in parts) == _render([t[2:] for t in turns[:300]])
    assert "".join(p.chosen for p in parts) == _render([t[2:] for t in turns[300:]])
    assert "".join(p.rejected for p in parts) == _render([t[2:] for t in other[300:]])
