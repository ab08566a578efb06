"""Token alignment against byte-by-byte comparison and whole-text encoding."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skufold.llm import align
from skufold.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    return align.Tokenizers(A, B)


def whole_tokens(t, text):
    """Ids and bytes of both over the whole text at once; empty where bytes differ."""
    a = t.a.encode(" " + text, add_special_tokens=False).ids
    b = t.b.encode(text)
    in_a, in_b = [t.bytes_a[i] for i in a], [t.bytes_b[i] for i in b]
    whole = (" " + text).encode()
    return (a, in_a, b, in_b) if text and b"".join(in_a) == whole == b"".join(in_b) else ([], [], [], [])


def by_bytes(lens_a, lens_b):
    """(groups, links) from the token of every byte."""
    owner_a, owner_b = np.repeat(np.arange(len(lens_a)), lens_a), np.repeat(np.arange(len(lens_b)), lens_b)
    links = sorted(set(zip(owner_a.tolist(), owner_b.tolist())))
    cuts = sorted(set(np.cumsum(lens_a).tolist()) & set(np.cumsum(lens_b).tolist()))
    groups, lo = [], 0
    for hi in cuts:
        groups.append((sorted(set(owner_a[lo:hi].tolist())), sorted(set(owner_b[lo:hi].tolist()))))
        lo = hi
    return groups, links


def expected(t, rows):
    tokens = [whole_tokens(t, text or "") for _, text in rows]
    found, docs = [], Counter()
    for a, in_a, b, in_b in tokens:
        groups, links = by_bytes([*map(len, in_a)], [*map(len, in_b)])
        pairs = [(a[i], b[j]) for i, j in links]
        docs.update(set(pairs))
        text = ";".join(",".join(str(a[i]) for i in x) + "|" + ",".join(str(b[j]) for j in y) for x, y in groups)
        found.append((len(a), len(b), len(groups), pairs, text))
    best = {}
    for (x, _), n in docs.items():
        best[x] = max(n, best.get(x, 0))
    return sorted(((doc_id or -1), n_a, n_b, n_g, len(pairs), sum(docs[p] == best[p[0]] for p in pairs),
                   sum(docs[p] for p in pairs), hashlib.sha256(g.encode()).hexdigest() if g else "", g)
                  for (doc_id, _), (n_a, n_b, n_g, pairs, g) in zip(rows, found))


def found(df):
    return sorted(((r.doc_id or -1), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups)
                  for r in df.collect())


ROWS = [
    (1, "The quick brown fox, and the quicker Übermut!  Two spaces\n\nlines\n and \t tabs "),
    (2, "<|endoftext|> <s> </s> <unk> <0x41> ▁ literal"), (3, None), (4, ""), (5, " "), (6, "   "), (7, "a  "),
    (8, "日本語テキスト と emoji 👩‍👩‍👧 و العربية  　x \x1c \x85 y"), (9, "x" * 3000), (10, "don't we'll I'm 1234567 ---===" * 30),
    (10, "don't we'll I'm 1234567 ---===" * 30), (None, "the quick brown fox"), (11, "\n"), (12, "\n  \n x\n  y \r\n z"),
    (13, "ab" * 40 + " " + "é" * 50 + "́"), (14, "a▁b ordinary words around"), (15, "zero\x00byte here"),
]


def test_documents_against_whole_texts(spark, tokenizers):
    rows = ROWS + [(100 + i, f"common words number {i} and then some more common words, {'abc' * (i % 5)}.") for i in range(60)]
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, block int, pairs string")
    want = expected(tokenizers, rows)
    for size in (200, 1 << 20):
        assert found(align.align_documents(docs, A, B, block_chars=size, with_groups=True)) == want


def test_given_documents(spark, tokenizers):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(align.align_documents(docs, A, B, with_groups=True)) == expected(tokenizers, rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align.align_documents(docs, A, B).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=60))
def test_align_any_lengths(lens_a, lens_b):
    gap = sum(lens_a) - sum(lens_b)
    (lens_b if gap > 0 else lens_a).extend([abs(gap)] * (gap != 0))
    ends_a, ends_b = np.cumsum(lens_a), np.cumsum(lens_b)
    groups, links = by_bytes(lens_a, lens_b)
    got = align.align(ends_a, ends_b).tolist()
    assert [(list(range(i, j)), list(range(k, m))) for i, j, k, m in got] == groups
    own = [(i + x, k + y) for i, j, k, m in got for x, y in align.overlaps(ends_a[i:j].tolist(), ends_b[k:m].tolist())]
    assert sorted(own) == links


def test_long_interval_without_cuts():
    ends_a, ends_b = np.append(np.arange(2, 40_001, 2), 40_001), np.append(np.arange(1, 40_000, 2), 40_001)
    assert align.align(ends_a, ends_b).tolist() == [[0, len(ends_a), 0, len(ends_b)]]
    ends_a, ends_b = np.append(ends_a, 40_002), np.append(ends_b, 40_002)
    assert len(align.align(ends_a, ends_b)) == 2


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .,\n\té▁日'1", max_size=60))
def test_units_are_encoded_as_in_their_text(text):
    t = align.Tokenizers(A, B) if not hasattr(test_units_are_encoded_as_in_their_text, "t") else test_units_are_encoded_as_in_their_text.t
    test_units_are_encoded_as_in_their_text.t = t
    if not text:
        return
    parts = [t.encode(u) for u in align.cut_units(text)]
    a, _, b, _ = whole_tokens(t, text)
    if a:
        assert [i for x, _, _ in parts for i in x.tolist()] == a
        assert [i for _, y, _ in parts for i in y.tolist()] == b
    else:
        assert not all(right for _, _, right in parts)
