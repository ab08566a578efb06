"""Packing tokenized documents into near-equal windows by multiway differencing.

A document's ids (with an end id) are cut into whole windows and a rest, the
rest into near-equal pieces. Pieces of a block of windows are dealt to k windows
by Karmarkar-Karp differencing: every piece starts as a partition of its own (k
sums, one of them not zero); the two partitions with the largest differences are
merged again and again, the fullest window of one with the emptiest of the
other, until one is left. Where its fullest window exceeds the capacity, k rises
and the block is dealt again. Blocks are made inside a partition, so nothing is
shuffled and a lost task repeats only its own partition.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, END_ID = 2048, 1
#: Longest piece of a rest; windows of one block on average.
PIECE, BLOCK_WINDOWS = 512, 128
#: Ids that a block leaves free per window, so that its first deal mostly fits.
MARGIN = 28
#: Characters of remembered words in a task, and of texts encoded at once.
MEMORY_CHARS, BATCH_CHARS = 12 << 20, 1 << 21
#: Fixed value: where a byte-level BPE always starts a new word: before a space
#: that follows something else than white space.
SEAM = re.compile(r"(?<=\S)(?= )")


class Encoder:
    """Ids of whole texts by a ``tokenizers`` file, as little-endian 32-bit bytes.

    Words never merge across a seam (SEAM), so each distinct word between seams
    is encoded once and remembered up to a bound.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.size = 0
        vocabulary = self.tokenizer.get_vocab()
        # a byte-level token has one character for each of its bytes
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)

    def _learn(self, known: dict[str, bytes], words: list[str], lead: str) -> None:
        self.size += sum(map(len, words))
        if lead and words:
            # words that begin after a seam do not change each other: one call
            spaced = [lead + w for w in words]
            found = self.tokenizer.encode_batch_fast(["".join(spaced)], add_special_tokens=False)[0]
            ids = np.array(found.ids, dtype="<u4")
            reach = np.cumsum(self.bytes_of[ids])
            ends = np.cumsum([len(w.encode()) for w in spaced])
            at = np.searchsorted(reach, ends)
            if at[-1] < len(reach) and (reach[at] == ends).all():
                raw, stops = ids.tobytes(), (4 * (at + 1)).tolist()
                known.update(zip(words, [raw[s:e] for s, e in zip([0] + stops, stops)]))
                return
        for w, e in zip(words, self.tokenizer.encode_batch([lead + w for w in words], add_special_tokens=False)):
            known[w] = array("I", e.ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.size > MEMORY_CHARS:
            self.known, self.first, self.size = {}, {}, 0
        split = [t.split(" ") for t in texts]
        need = {w for parts in split for w in parts[1:]}.difference(self.known)
        odd = {w for w in need if not w or w[0].isspace()}
        self._learn(self.known, list(need - odd), " ")
        # runs of white space are words of their own: cut only at seams
        seamed = {i: SEAM.split(texts[i]) for i, parts in enumerate(split)
                  if not odd.isdisjoint(parts[1:]) or parts[0].isspace()} if odd or any(
            p[0].isspace() for p in split) else {}
        heads = {parts[0] for i, parts in enumerate(split) if i not in seamed}
        heads.update(w for parts in seamed.values() for w in parts)
        self._learn(self.first, list(heads.difference(self.first)), "")
        out = []
        for i, parts in enumerate(split):
            if i in seamed:
                out.append(b"".join(map(self.first.__getitem__, seamed[i])))
            else:
                out.append(self.first[parts[0]] + b"".join(map(self.known.__getitem__, parts[1:])))
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(tokens: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length): whole windows, then near-equal pieces of the rest."""
    whole = tokens // capacity
    out = [(i * capacity, capacity) for i in range(whole)]
    rest = tokens - whole * capacity
    n = -(-rest // piece)
    ends = [whole * capacity + rest * i // n for i in range(n + 1)] if n else []
    return out + [(a, b - a) for a, b in zip(ends, ends[1:])]


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: deal sizes to k windows; returns positions by window."""
    parts, left, right = {}, [], []
    heap = []
    for i, s in enumerate(sizes):
        sums, node = np.zeros(k, dtype=np.int64), np.full(k, -1, dtype=np.int64)
        sums[0], node[0] = s, i
        parts[i] = (sums, node)
        heap.append((-s, i))
    heapq.heapify(heap)
    n, made = len(sizes), len(sizes)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (sa, na), (sb, nb) = parts.pop(a), parts.pop(b)
        sums, nb = sa + sb[::-1], nb[::-1]
        both = np.flatnonzero((na >= 0) & (nb >= 0))
        node = np.maximum(na, nb)
        node[both] = n + len(left) + np.arange(len(both))
        left += na[both].tolist()
        right += nb[both].tolist()
        order = np.argsort(-sums, kind="stable")
        parts[made] = (sums[order], node[order])
        heapq.heappush(heap, (-int(sums[order[0]] - sums[order[-1]]), made))
        made += 1
    if not parts:
        return []
    out = []
    for root in parts[heap[0][1]][1].tolist():
        members, stack = [], [root] if root >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                members.append(x)
            else:
                stack += [left[x - n], right[x - n]]
        out.append(sorted(members))
    return out


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Positions by window, none above the capacity, from ceil(sum / capacity)
    windows up; no size exceeds the capacity."""
    total = sum(sizes)
    k = max(1, -(-total // capacity))
    while sizes:
        found = difference(sizes, k)
        if max(sum(sizes[i] for i in w) for w in found) <= capacity:
            return [w for w in found if w]
        k += 1
    return []


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, if asked for, ids.

    ``tokenizer`` is the path of a ``tokenizers`` file on every machine. Each
    input row is a document of its own (repeated rows and null ids too); a null
    or empty text has the end id alone. Sequences hold at most ``capacity`` ids,
    their pieces lie without a gap from offset 0. Sequence ids are unique and,
    for the same partitions, the same in every run. An empty table gives no rows;
    other columns are not read. A task holds one batch of texts, the ids of one
    block of windows and a bounded memory of words.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = (f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
              "offset long" + ", ids array<int>" * with_ids)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base, made = encoder(tokenizer).encode, TaskContext.get().partitionId() << 32, 0
        waiting: list[tuple] = []  # doc_id, start, length, crc, doc_tokens, ids
        held, kind = 0, None

        def rows_of(groups: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal made
            out, raw = [], []
            for g in groups:
                offset = 0
                for p in g:
                    out.append((*p[:5], base + made, offset))
                    raw.append(p[5])
                    offset += p[2]
                made += 1
            cols = [pa.array(c, kind if i == 0 else pa.int64()) for i, c in enumerate(zip(*out))]
            if with_ids:
                flat = np.frombuffer(b"".join(raw), dtype="<i4")
                ends = np.cumsum([0] + [len(x) // 4 for x in raw]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            return pa.RecordBatch.from_arrays(cols, names)

        def dealt() -> pa.RecordBatch:
            nonlocal held
            found = windows([p[2] for p in waiting], capacity)
            out = rows_of([[waiting[i] for i in w] for w in found])
            waiting.clear()
            held = 0
            return out

        for b in batches:
            kind = b.column(0).type
            keys = b.column(0).to_pylist()
            texts = [(x.as_py() or b"").decode("utf-8", "replace") for x in b.column(1)]
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) <= BATCH_CHARS):
                    chars += len(texts[to])
                    to += 1
                full = []
                for key, ids in zip(keys[at:to], encode(texts[at:to])):
                    ids += end
                    tokens = len(ids) // 4
                    for start, length in cuts(tokens, capacity):
                        own = ids[4 * start:4 * (start + length)]
                        piece = (key, start, length, zlib.crc32(own), tokens, own if with_ids else b"")
                        if length == capacity:
                            full.append([piece])
                        else:
                            waiting.append(piece)
                            held += length
                        if held >= BLOCK_WINDOWS * (capacity - MARGIN):
                            yield dealt()
                if full:
                    yield rows_of(full)
                at = to
        if waiting:
            yield dealt()
    return rows.mapInArrow(run, schema)
