"""Cross-tokenizer alignment: which ids of two tokenizers cover the same bytes.

``align`` divides and conquers two token sequences over the same bytes: it looks for a
byte at which tokens of both end, from the middle outwards and by bisect, cuts there
and goes on with both halves; an interval without such a byte is a group.
``align_documents`` aligns whole texts, counts for every pair of overlapping ids the
documents that hold it, and returns one row per document.

A space after anything that is no white space begins a token in both (``cut_units``;
checked against the second vocabulary), so a text is first cut there into units.
A unit's tokens do not depend on the text around it, so each distinct unit is encoded
and aligned once per block and looked up where it recurs.

Blocks of ``BLOCK_CHARS`` characters of whole texts are written with their units'
links, once, to the shared checkpoint folder. What is shuffled are the distinct id
pairs of a block, which are counted, and the blocks themselves, which meet the counts
of their own pairs; no table of all pairs is sent anywhere. A task holds one block,
or one longer text.

Null and empty texts, and texts whose tokens of either kind do not join to the text's
bytes, have no tokens: all numbers 0 and empty strings. Rows that repeat are documents
of their own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

BLOCK_CHARS = 1 << 21
#: Tokens on either side of a middle that are tried one by one.
NEAR = 8
#: Distinct units that a worker keeps.
KEPT = 500_000
#: New units that are encoded in one call.
AT_ONCE = 4096
_CUT, _SPACES = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s ")


def align(ends_a: np.ndarray, ends_b: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Groups, a row (first a, end a, first b, end b) each and in order, of two token
    sequences, given where each token ends; both end at the same byte. ``starts``: such
    rows to divide, for many sequences one after the other."""
    todo = np.array([[0, len(ends_a), 0, len(ends_b)]]) if starts is None else starts
    todo = todo[todo[:, 1] > todo[:, 0]]
    done = [todo[:0]]
    while len(todo):
        one = (todo[:, 1] - todo[:, 0] <= 1) | (todo[:, 3] - todo[:, 2] <= 1)
        done.append(todo[one])
        todo = todo[~one]
        if not len(todo):
            break
        i, j = _common_ends(ends_a, ends_b, todo)
        cut = i >= 0
        done.append(todo[~cut])
        a, end_a, b, end_b = todo[cut].T
        i, j = i[cut] + 1, j[cut] + 1
        todo = np.concatenate((np.stack((a, i, b, j), 1), np.stack((i, end_a, j, end_b), 1)))
    groups = np.concatenate(done)
    return groups[np.argsort(groups[:, 0])]


def _common_ends(ends_a: np.ndarray, ends_b: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per interval the tokens nearest to its middle that end together before its own
    end; -1: there are none."""
    first, last = parts[:, 0], parts[:, 1] - 1
    middle = (first + last) // 2
    i, j = np.full(len(parts), -1), np.full(len(parts), -1)
    open_ = np.arange(len(parts))
    for step in range(NEAR):
        for at in (middle[open_] - step, middle[open_] + step)[:1 + (step > 0)]:
            ok = (at >= first[open_]) & (at < last[open_]) & (i[open_] < 0)
            k, at = open_[ok], at[ok]
            found = np.searchsorted(ends_b, ends_a[at])
            hit = ends_b[found] == ends_a[at]
            i[k[hit]], j[k[hit]] = at[hit], found[hit]
        open_ = open_[(i[open_] < 0) & ((middle[open_] - step > first[open_]) | (middle[open_] + step < last[open_]))]
    for k in open_:  # the rest with windows that double
        width = 2 * NEAR
        while i[k] < 0:
            lo, hi = max(first[k], middle[k] - width), min(last[k], middle[k] + width)
            found = np.searchsorted(ends_b, ends_a[lo:hi])
            hits = np.flatnonzero(ends_b[found] == ends_a[lo:hi])
            if len(hits):
                best = hits[np.argmin(np.abs(hits + lo - middle[k]))]
                i[k], j[k] = best + lo, found[best]
            elif lo == first[k] and hi == last[k]:
                break
            width *= 2
    return i, j


def overlaps(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """Pairs of tokens of a group that share bytes."""
    i, j, out = 0, 0, []
    while i < len(ends_a) and j < len(ends_b):
        out.append((i, j))
        x, y = ends_a[i], ends_b[j]
        i += x <= y
        j += y <= x
    return out


def byte_level_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain}
    return shown | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class Tokenizers:
    """Two tokenizers: ids and bytes of a unit's tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letter = byte_level_alphabet()
        with open(path_a, encoding="utf-8") as f:
            added = {x["id"] for x in json.load(f)["added_tokens"]}
        self.bytes_a = {i: bytes(letter[c] for c in t) for t, i in self.a.get_vocab().items() if i not in added}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_a = [self.bytes_a.get(i, b"") for i in range(max(self.bytes_a) + 1 + len(added))]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        #: False if a piece has a space inside: then tokens may cross unit borders
        self.units = not any(re.search("[^▁]▁", p) for p in pieces)
        self.space = self.b.piece_to_id("▁")
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))

    def encode(self, key: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids of " " + key by both, and whether both join to its bytes; the second
        adds the space by itself, but for nothing."""
        a = self.a.encode_batch_fast([" " + key], add_special_tokens=False)[0].ids
        b = self.b.encode(key) if key else [self.space]
        whole = (" " + key).encode()
        right = b"".join(map(self.bytes_a.__getitem__, a)) == whole == b"".join(map(self.bytes_b.__getitem__, b))
        return np.array(a, np.int64), np.array(b, np.int64), right


def cut_units(text: str) -> list[str]:
    """Pieces whose concatenation, a space before each, is the text with a space before it."""
    spaced = " " + text
    return [u[1:] for u in _CUT.split(spaced)] if _SPACES.search(spaced) else text.split(" ")


class Units:
    """What is known of distinct units: numbers of tokens and their groups; and of
    distinct groups: their text and linked id pairs (a << 32 | b, one entry a link)."""

    def __init__(self, path_a: str, path_b: str):
        self.tokenizers = Tokenizers(path_a, path_b)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.numbers = {n: array("q") for n in ("n_a", "n_b", "start", "n_groups", "wrong")}
        self.sequence = array("q")
        self.group_index: dict[bytes, int] = {}
        self.group_text: list[str] = []
        self.group_links: list[np.ndarray] = []

    def number(self, name: str) -> np.ndarray:
        return np.frombuffer(self.numbers[name], np.int64).copy()

    def cut(self, text: str) -> list[str]:
        return cut_units(text) if self.tokenizers.units else [text]

    def learn(self, keys: list[str]) -> None:
        """Units that end in no white space do not change each other: one call for many."""
        plain = [k for k in keys if k and not k[-1].isspace()] if self.tokenizers.units else []
        single = [k for k in keys if not k or k[-1].isspace()] if self.tokenizers.units else keys
        for i in range(0, len(plain), AT_ONCE):
            part = plain[i:i + AT_ONCE]
            a, b, right = self.tokenizers.encode(" ".join(part))
            ends = np.cumsum([len(k.encode()) + 1 for k in part])
            ends_a, ends_b = np.cumsum(self.tokenizers.size_a[a]), np.cumsum(self.tokenizers.size_b[b])
            if right:
                at, bt = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
                if (ends_a[at] == ends).all() and (ends_b[bt] == ends).all():
                    self._keep(part, a, b, ends_a, ends_b, at + 1, bt + 1, np.zeros(len(part), bool))
                    continue
            single += part
        if single:
            found = [self.tokenizers.encode(k) for k in single]
            wrong = np.array([not right for _, _, right in found])
            a, b = ([x[n] if x[2] else x[n][:0] for x in found] for n in (0, 1))
            at, bt = (np.cumsum([len(x) for x in side]) for side in (a, b))
            a, b = np.concatenate(a), np.concatenate(b)
            self._keep(single, a, b, np.cumsum(self.tokenizers.size_a[a]), np.cumsum(self.tokenizers.size_b[b]),
                       at, bt, wrong)

    def _keep(self, keys, a, b, ends_a, ends_b, at, bt, wrong) -> None:
        """Units' tokens, one unit after the other, up to at and bt."""
        from_a, from_b = np.concatenate(([0], at[:-1])), np.concatenate(([0], bt[:-1]))
        groups = align(ends_a, ends_b, np.stack((from_a, at, from_b, bt), 1))
        many = np.bincount(np.searchsorted(at, groups[:, 0], side="right"), minlength=len(keys))
        raw_a, raw_b = a.astype("<u4").tobytes(), b.astype("<u4").tobytes()
        known, new = self.group_index, []
        first = len(self.sequence)
        for i, j, k, m in (4 * groups).tolist():
            name = raw_a[i:j] + b"|" + raw_b[k:m]
            if (at_ := known.get(name)) is None:
                at_ = known[name] = len(known)
                new.append((i // 4, j // 4, k // 4, m // 4))
            self.sequence.append(at_)
        for i, j, k, m in new:
            x, y = a[i:j].tolist(), b[k:m].tolist()
            self.group_text.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
            self.group_links.append(np.array([x[p] << 32 | y[q] for p, q in overlaps(
                ends_a[i:j].tolist(), ends_b[k:m].tolist())], np.int64))
        self.index.update(zip(keys, range(len(self.index), len(self.index) + len(keys))))
        for name, x in (("n_a", at - from_a), ("n_b", bt - from_b), ("start", first + np.cumsum(many) - many),
                        ("n_groups", many), ("wrong", wrong)):
            self.numbers[name].frombytes(x.astype(np.int64).tobytes())


@lru_cache(maxsize=1)
def worker_units(path_a: str, path_b: str) -> Units:
    return Units(path_a, path_b)


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def _runs(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start, start + 1, ..., for each start as many as told."""
    return np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())


def _block(texts: list[str | None], units: Units) -> dict[str, list]:
    """One block: per document its numbers, groups' texts and groups, per distinct group
    its pairs, and the distinct pairs with the number of documents that hold them."""
    if len(units.index) > KEPT:
        units.clear()
    cut = [units.cut(t) if t else [] for t in texts]
    seen = set().union(*cut) if cut else set()
    if new := [u for u in seen if u not in units.index]:
        units.learn(new)
    at = [np.fromiter(map(units.index.__getitem__, c), np.int64, len(c)) for c in cut]
    wrong = units.number("wrong")
    at = [x if len(x) and not wrong[x].any() else x[:0] for x in at]
    doc_of = np.repeat(np.arange(len(at)), [len(x) for x in at])
    flat = np.concatenate([*at, np.zeros(0, np.int64)])
    by_doc = lambda x: np.bincount(doc_of, x, len(at)).astype(np.int64)
    out: dict[str, list] = {n: by_doc(units.number(n)[flat]) for n in ("n_a", "n_b", "n_groups")}
    out["n_links"] = out["n_a"] + out["n_b"] - out["n_groups"]
    many = units.number("n_groups")[flat]
    sequence = np.frombuffer(units.sequence, np.int64)[_runs(units.number("start")[flat], many)]
    text = [units.group_text[i] for i in sequence.tolist()]
    ends = np.concatenate(([0], np.cumsum(out["n_groups"])))
    out["groups"] = [";".join(text[i:j]) for i, j in zip(ends.tolist(), ends[1:].tolist())]
    own, place = np.unique(sequence, return_inverse=True)
    held = [units.group_links[i] for i in own.tolist()]
    size = np.fromiter(map(len, held), np.int64, len(held))
    pairs, pair = np.unique(np.concatenate([*held, np.zeros(0, np.int64)]), return_inverse=True)
    # (document, group) once, then (document, pair) once, then documents by pair
    n_own, n_pairs = max(len(own), 1), max(len(pairs), 1)
    doc, group = np.divmod(np.unique(np.repeat(np.arange(len(at)), out["n_groups"]) * n_own + place), n_own)
    links = pair[_runs((np.cumsum(size) - size)[group], size[group])]
    both = np.unique(np.repeat(doc, size[group]) * n_pairs + links)
    out |= {"sequence": _packed(place), "group_links": size, "links": _packed(pair), "pairs": pairs,
            "pair_docs": np.bincount(both % n_pairs, minlength=len(pairs))}
    return out


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in 2 or 4 bytes each; the first byte says which."""
    wide = len(x) > 0 and int(x.max()) >= 1 << 16
    return bytes([4 if wide else 2]) + x.astype("<u4" if wide else "<u2").tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


def _blocks(docs: DataFrame, id_col: str, text_col: str, path_a: str, path_b: str, block_chars: int,
            with_groups: bool) -> DataFrame:
    """One written row per block of documents."""
    id_type = docs.schema[id_col].dataType.simpleString()
    lists = {"ids": f"array<{id_type}>", **{n: "array<long>" for n in NUMBERS}, "sha256": "array<string>",
             "groups": "array<string>", "sequence": "binary", "group_links": "array<int>",
             "links": "binary", "pairs": "array<long>", "pair_docs": "array<int>"}
    schema = "block long, " + ", ".join(f"{n} {t}" for n, t in lists.items())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = worker_units(path_a, path_b)
        part, count = TaskContext.get().partitionId() << 33, 0

        def row(ids: list[pa.Array], texts: list[str | None]) -> pa.RecordBatch:
            out = _block(texts, units)
            sha = ["" if not g else hashlib.sha256(g.encode()).hexdigest() for g in out["groups"]]
            kept = out["groups"] if with_groups else [None] * len(texts)
            ints = lambda x, t: pa.array([x], pa.list_(t))
            whole = pa.concat_arrays(ids)
            columns = [pa.array([part + count]),
                       pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole),
                       *(ints(out[n], pa.int64()) for n in NUMBERS),
                       ints(sha, pa.string()), ints(kept, pa.string()),
                       pa.array([out["sequence"]], pa.binary()), ints(out["group_links"], pa.int32()),
                       pa.array([out["links"]], pa.binary()), ints(out["pairs"], pa.int64()),
                       ints(out["pair_docs"], pa.int32())]
            return pa.RecordBatch.from_arrays(columns, ["block", *lists])
        ids, texts, size = [], [], 0
        for batch in batches:
            column, first = batch.column(1), 0
            for i, text in enumerate(column.cast(pa.binary()).to_pylist()):
                if text is not None:
                    try:
                        texts.append(text.decode())
                    except UnicodeDecodeError:  # no tokens join to such bytes
                        texts.append(None)
                else:
                    texts.append(None)
                size += len(text or b"") + 1
                if size >= block_chars:
                    yield row([*ids, batch.column(0)[first:i + 1]], texts)
                    count, ids, texts, size, first = count + 1, [], [], 0, i + 1
            ids.append(batch.column(0)[first:])
        if texts:
            yield row(ids, texts)
    path = scratch_path(docs.sparkSession, "aligned")
    docs.select(id_col, text_col).mapInArrow(encode, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def id_pairs(blocks: DataFrame) -> DataFrame:
    """(pair, docs, best): documents that hold an id pair linked, and whether no pair
    of its first id has more."""
    pairs = (blocks.select(F.explode(F.arrays_zip("pairs", "pair_docs")).alias("p"))
             .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pair_docs").alias("docs")))
    a = F.shiftright("pair", 32)
    most = pairs.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    return pairs.withColumn("a", a).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _finish(blocks: DataFrame, id_type: str) -> DataFrame:
    """Blocks that have met the counts of their pairs -> one row per document."""
    numbers = [*NUMBERS, "n_best", "count_sum"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cell = {n: batch.column(n)[k] for n in batch.schema.names}
                flat = lambda n: cell[n].values.to_numpy(zero_copy_only=False)  # noqa: E731,B023
                answer = cell["answer"].values
                docs, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if answer is not None:
                    order = np.argsort(answer.field("pair").to_numpy())
                    docs = answer.field("docs").to_numpy()[order]
                    best = answer.field("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
                link = _unpacked(cell["links"].as_py())
                before = lambda x: np.concatenate(([0], np.cumsum(x)))
                ends = before(flat("group_links"))
                group = _unpacked(cell["sequence"].as_py())
                doc_ends = before(flat("n_groups"))
                found = []
                for value in (best, docs):  # sums by group, then by document
                    total = before(value[link])
                    by_group = total[ends[1:]] - total[ends[:-1]]
                    run = before(by_group[group])
                    found.append(pa.array(run[doc_ends[1:]] - run[doc_ends[:-1]], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [cell["ids"].values, *(cell[n].values for n in NUMBERS), *found, cell["sha256"].values,
                     cell["groups"].values], ["id", *numbers, "groups_sha256", "groups"])
    schema = f"id {id_type}, " + ", ".join(f"{n} long" for n in numbers) + ", groups_sha256 string, groups string"
    return blocks.mapInArrow(rows, schema)


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                    block_chars: int = BLOCK_CHARS, with_groups: bool = False) -> DataFrame:
    """One row per document: its id, n_a and n_b tokens of " " + text by the byte-level
    tokenizer at path_a and the SentencePiece model at path_b, n_groups, n_links
    (overlapping occurrences), n_best (links whose id pair is the most frequent of its
    first id), count_sum (documents of each link's pair, summed), groups_sha256 and,
    if asked for, the groups themselves (``a1,a2|b1;...``)."""
    blocks = _blocks(docs, id_col, text_col, path_a, path_b, block_chars, with_groups)
    wanted = blocks.select("block", F.explode("pairs").alias("pair"))
    answers = (wanted.join(id_pairs(blocks), "pair").groupBy("block")
               .agg(F.collect_list(F.struct("pair", "docs", "best")).alias("answer")))
    met = blocks.drop("pairs", "pair_docs").join(answers, "block", "left")
    out = _finish(met, docs.schema[id_col].dataType.simpleString()).withColumnRenamed("id", id_col)
    return out if with_groups else out.drop("groups")
