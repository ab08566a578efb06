"""Stupid-backoff language-model scores of every document, relationally.

A word's score is count(n-gram) / count(its prefix); where the n-gram does not
occur, ALPHA times the score one order lower; the lowest order is count(word) /
all words. Counts come from all *other* documents, so a text does not vouch for
itself: its own occurrences are taken off each count.

Plan: documents are dealt into blocks by hash. Each block explodes its n-grams
to 64-bit hashes and sends every distinct one with its count to the partition
that owns the hash (first shuffle); the partition adds up its count table and
answers every block (second shuffle); a block joins the answers to its exploded
n-grams and sums by document. Distinct n-grams of a block travel packed, sorted
and as differences, so an n-gram that is in every document costs one entry per
block. N-grams of equal hash count as one. Texts travel once, compressed by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER, ALPHA = 3, 0.4
#: Bytes of text in a block on average; as many hash partitions as blocks.
BLOCK_BYTES = 8 << 20
#: Bytes of words hashed at once; fewest numbers whose high bytes are compressed.
CHUNK, PACKED = 1 << 20, 256
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _MIX[2])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the position of each text's first word (and the end)."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.diff(np.concatenate(([0], inside.view(np.int8))))
    starts = np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    stops = np.flatnonzero(edge == -1)
    length = stops - starts
    power = np.multiply.accumulate(np.full(int(length.max()) + 1, _MIX[2] | np.uint64(1), dtype=np.uint64))
    first = np.concatenate(([0], np.cumsum(length)))
    cuts = np.unique(np.concatenate((np.searchsorted(first, np.arange(0, int(first[-1]), CHUNK)), [len(starts)])))
    sums = np.empty(len(starts), dtype=np.uint64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        at, n = slice(starts[a], stops[b - 1]), length[a:b]
        begin = first[a:b] - first[a]
        place = np.arange(int(n.sum())) - np.repeat(begin, n)
        sums[a:b] = np.add.reduceat(_BYTES[raw[at][inside[at]]] * power[place], begin)
    return mix(sums ^ length.astype(np.uint64)), np.searchsorted(starts, np.concatenate(([0], ends)))


def grams(texts: list[bytes], order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For k = 1 to order: hashes of the k-grams that end at each word, and which
    words have one; and each text's first word."""
    h, first = word_hashes(texts)
    place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    out, valid = [h], [np.ones(len(h), dtype=bool)]
    for k in range(2, order + 1):
        before = np.concatenate((np.zeros(1, dtype=np.uint64), out[-1][:-1]))[:len(h)]
        out.append(mix(before * _MIX[2] + h + np.uint64(k)))
        valid.append(place >= k - 1)
    return out, valid, first


def _narrow(x: np.ndarray) -> bytes:
    """Unsigned integers as planes of their bytes, lowest first, up to the highest
    byte in use. The two highest planes hardly vary and are compressed."""
    w = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T
    if len(x) < PACKED:
        return bytes([w]) + planes.tobytes()
    low = max(0, w - 2)
    high = [pa.compress(p.tobytes(), codec="zstd", asbytes=True) for p in planes[low:]]
    return b"".join([bytes([w + 8]), len(x).to_bytes(4, "little"), planes[:low].tobytes(),
                     *[len(p).to_bytes(4, "little") + p for p in high]])


def _wide(raw: bytes) -> np.ndarray:
    w = raw[0]
    if w <= 8:
        n = (len(raw) - 1) // w
        planes = [raw[1 + n * i:1 + n * (i + 1)] for i in range(w)]
    else:
        w, n = w - 8, int.from_bytes(raw[1:5], "little")
        low = max(0, w - 2)
        planes, at = [raw[5 + n * i:5 + n * (i + 1)] for i in range(low)], 5 + n * low
        for _ in range(low, w):
            size = int.from_bytes(raw[at:at + 4], "little")
            planes.append(pa.decompress(raw[at + 4:at + 4 + size], n, codec="zstd", asbytes=True))
            at += 4 + size
    out = np.zeros((n, 8), dtype=np.uint8)
    for i, p in enumerate(planes):
        out[:, i] = np.frombuffer(p, dtype=np.uint8)
    return out.reshape(-1).view("<u8")


def _owner(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
              alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_words, logprob (natural, summed), score
    (logprob per word), backoffs (words scored at a lower order than their
    place allows), unseen (words in no other document).

    Words are runs of anything but ASCII white space, as they are written. A
    word that no other document has scores as if it had occurred once. Null and
    empty texts have n_words 0, logprob 0 and a null score. All other words count
    as one at least, so the only document of a table has finite scores too. Rows
    that repeat are documents of their own. Other columns are not read; an empty
    table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(1, math.ceil(size / block_bytes))
    rows = docs.select(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(parts)).cast("int").alias("block"),
                       F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch]).sort_by("block")
            number = t["block"].to_numpy()
            starts = np.flatnonzero(np.diff(number, prepend=-1))
            out = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(number)]):
                texts = [x or b"" for x in t["text"][a:b].to_pylist()]
                out.append((int(number[a]), t["doc_id"][a:b].to_pylist(), [len(x) for x in texts],
                            pa.compress(b"".join(texts), codec="zstd", asbytes=True)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, x) for c, x in zip(zip(*out), (pa.int32(), pa.list_(t["doc_id"].type),
                                                            pa.list_(pa.int64()), pa.binary()))],
                names=["block", "ids", "sizes", "texts"])

    def texts_of(t: pa.Table) -> list[bytes]:
        out = []
        for sizes, raw in zip(t["sizes"].to_pylist(), t["texts"].to_pylist()):
            raw, ends = pa.decompress(raw, sum(sizes), codec="zstd", asbytes=True), np.cumsum([0, *sizes]).tolist()
            out += [raw[a:b] for a, b in zip(ends, ends[1:])]
        return out

    def ask(t: pa.Table) -> pa.Table:
        hashes, valid, first = grams(texts_of(t), order)
        block = t["block"][0].as_py()
        out = [(0, block, 0, _narrow(np.zeros(1, dtype=np.uint64)), _narrow(first[-1:].astype(np.uint64)))]
        for k, (h, ok) in enumerate(zip(hashes, valid), 1):
            u, n = np.unique(h[ok], return_counts=True)
            ends = np.searchsorted(_owner(u, parts), np.arange(1, parts + 1, dtype=np.uint64))
            for p in np.flatnonzero(np.diff(np.concatenate(([0], ends)))).tolist():
                a, b = int(ends[p - 1]) if p else 0, int(ends[p])
                out.append((p, block, k, bytes(u[a:a + 1].tobytes()) + _narrow(np.diff(u[a:b])),
                            _narrow(n[a:b])))
        return pa.table([pa.array(c, x) for c, x in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.binary(),
                                                                   pa.binary()))],
                        names=["part", "block", "k", "hashes", "counts"])

    def answer(t: pa.Table) -> pa.Table:
        ks, blocks = t["k"].to_pylist(), t["block"].to_pylist()
        hashes, counts = t["hashes"].to_pylist(), t["counts"].to_pylist()
        out = []
        for k in sorted(set(ks)):
            own = [i for i, x in enumerate(ks) if x == k]
            keys = []
            for i in own:
                if k:
                    start = np.frombuffer(hashes[i][:8], dtype="<u8")
                    keys.append(np.cumsum(np.concatenate((start, _wide(hashes[i][8:]))), dtype=np.uint64))
                else:
                    keys.append(_wide(hashes[i]))
            _, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate([_wide(counts[i]) for i in own])).astype(np.uint64)
            ends = np.cumsum([len(x) for x in keys])
            out += [(blocks[i], k, t["part"][0].as_py(), _narrow(total[at[e - len(x):e]]))
                    for i, x, e in zip(own, keys, ends)]
        return pa.table([pa.array(c, x) for c, x in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))],
                        names=["block", "k", "part", "totals"])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        hashes, valid, first = grams(texts_of(left), order)
        n, texts = int(first[-1]), len(first) - 1
        lens = np.diff(first)
        of = np.repeat(np.arange(texts), lens)
        found = sorted(zip(right["k"].to_pylist(), right["part"].to_pylist(), right["totals"].to_pylist()))
        everything = int(_wide(found[0][2])[0])
        others = []  # by order: occurrences of each word's k-gram in other documents
        for k, (h, ok) in enumerate(zip(hashes, valid), 1):
            u, at = np.unique(h[ok], return_inverse=True)
            totals = [_wide(x) for j, _, x in found if j == k]
            totals = np.concatenate(totals) if totals else np.empty(0, dtype=np.uint64)
            if len(totals) != len(u):
                raise RuntimeError("a block's answers do not fit its n-grams")
            _, pair, own = np.unique(of[ok] * np.int64(len(u) + 1) + at, return_inverse=True, return_counts=True)
            rest = np.zeros(n)
            rest[ok] = totals[at].astype(np.float64) - own[pair]
            others.append(rest)
        all_other = np.maximum(everything - lens, 1).astype(float)[of] if n else np.empty(0)
        place = np.arange(n) - np.repeat(first[:-1], lens)
        most = np.minimum(place + 1, order)
        level = np.zeros(n, dtype=np.int64)
        for k in range(1, order + 1):
            level[others[k - 1] > 0] = k
        value = -np.log(all_other)
        for k in range(1, order + 1):
            w = np.flatnonzero(level == k)
            value[w] = np.log(others[k - 1][w]) - np.log(others[k - 2][w - 1] if k > 1 else all_other[w])
        value += (most - level) * math.log(alpha)
        by = lambda x: np.bincount(of, weights=x, minlength=texts)
        total = by(value).astype(float)
        score = [t / m if m else None for t, m in zip(total.tolist(), lens.tolist())]
        ids = pc.list_flatten(left["ids"])
        return pa.table([ids, pa.array(lens.astype(np.int64)), pa.array(total), pa.array(score, pa.float64()),
                         pa.array(by(level < most).astype(np.int64)), pa.array(by(level == 0).astype(np.int64))],
                        names=["doc_id", "n_words", "logprob", "score", "backoffs", "unseen"])

    rows = rows.mapInArrow(pack, f"block int, ids array<{id_type}>, sizes array<long>, texts binary")
    asked = rows.groupBy("block").applyInArrow(ask, "part int, block int, k int, hashes binary, counts binary")
    answered = asked.groupBy("part").applyInArrow(answer, "block int, k int, part int, totals binary")
    return (rows.groupBy("block").cogroup(answered.groupBy("block"))
            .applyInArrow(finish, f"doc_id {id_type}, n_words long, logprob double, score double, backoffs long, unseen long"))
