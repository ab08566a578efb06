import hashlib
import re

from skufold.llm import exact_dedup as ed
from skufold.session import scratch_path


def _rows():
    return [(3, "a  b"), (1, "a b"), (2, "a\t\nb"), (None, "a b"), (7, None), (5, ""), (9, " "), (8, "x" * 200_000),
            (4, "x" * 200_000), (6, "u v"), (10, "u v"), (11, "same"), (11, "same")]


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, True) for r in rows],
                                 "doc_id long, text string, digest string, keep_id long, kept boolean")


def test_batch_matches_brute_force(spark):
    index = ed.DigestIndex(spark, scratch_path(spark, "ix"), buckets=4)
    got = ed.dedup_batch(ed.digests(_docs(spark, _rows())), index, "one").collect()
    groups = {}
    for i, t in _rows():
        groups.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).digest(), []).append(i)
    assert len(got) == len(_rows())
    kept = {}
    for r in got:
        ids = groups[bytes(r.digest)]
        assert r.keep_id == min(i for i in ids if i is not None) and r.group_size == len(ids)
        kept.setdefault(bytes(r.digest), []).append(r.kept)
        assert not r.kept or r.doc_id == r.keep_id
    assert all(sum(k) == 1 for k in kept.values()) and index.read().count() == len(groups)
    # a later batch: what the index holds is dropped, the rest is appended
    more = [(0, "a b"), (20, "new"), (21, "new")]
    later = {r.doc_id: r for r in ed.dedup_batch(ed.digests(_docs(spark, more)), index, "two").collect()}
    assert not later[0].kept and later[0].keep_id == 1 and later[20].kept and not later[21].kept
    # the same batch again, as after a run that was lost behind its append: the same rows
    again = {r.doc_id: r for r in ed.dedup_batch(ed.digests(_docs(spark, more)), index, "two").collect()}
    assert again == later and index.read().count() == len(groups) + 1
    first = ed.dedup_batch(ed.digests(_docs(spark, _rows())), index, "one").collect()
    assert sorted(map(str, first)) == sorted(map(str, got)) and index.read().count() == len(groups) + 1
    # another handle on the same path sees the same index
    other = ed.DigestIndex(spark, index.path, buckets=4)
    assert other.read().count() == len(groups) + 1


def test_rows_that_stay_have_their_columns(spark):
    docs = _docs(spark, _rows())
    out = ed.deduplicate(docs, ed.DigestIndex(spark, scratch_path(spark, "ix")), "b")
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(["1", "5", "9", "4", "6", "10", "11"])
    empty = ed.deduplicate(docs.limit(0), ed.DigestIndex(spark, scratch_path(spark, "ix")), "b")
    assert empty.count() == 0
