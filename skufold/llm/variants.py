"""Spelling variant grouping: words one edit apart, found by dense prefix-suffix tiles.

Words come from the texts (``word_counts``); two are near if they differ by one
inserted, deleted or replaced code point (``near_words``); a word's form is its
most frequent near word, where that is frequent enough, and its root the end of
the chain of forms (``variant_forms``).

Two words of which the longer has L code points are one edit apart exactly if
their lengths differ by at most one and common prefix plus common suffix reach
L - 1. One of the two then has ceil((L - 1) / 2) code points, so every pair lies
in a group of words with that prefix or that suffix. Groups are cut into blocks
of ``BLOCK`` words and every pair of blocks of a group is a tile: a dense
comparison of two padded code-point matrices, column by column. A pair is taken in
the prefix group if there is one, else in the suffix group, so once. Hot groups make
more tiles, never a larger one; only pairs one edit apart leave a tile, and a word
has few of those (letters x places).

Null texts, and texts without a run, have no words; a null id counts as an empty
one. Rows that repeat count each time, with the same deletions if id and text
repeat. Words may be of any length: a block holds fewer long ones. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sizing import cpu_partitions
from .common import whole_groups, written

LETTERS = "a-zÀ-ÿ"
#: Fixed values of the contract.
EVERY, LEAST_CHARS, LEAST_N, RATIO = 97, 5, 3, 2
#: Words in a block, code points in a block's matrix, and words of small groups that share a tile.
BLOCK, BLOCK_CHARS, SHARED = 1024, 1 << 20, 128
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def occurrences(doc_id: str, text: bytes, least: int = LEAST_CHARS, every: int = EVERY) -> list[str]:
    """A text's runs of letters of at least ``least`` code points, A-Z lower-cased;
    where ``every`` divides the crc32 of ``id:run``, one code point is deleted (such
    a run may be one shorter than ``least``)."""
    runs = re.findall(f"[{LETTERS}]{{{least},}}", text.translate(_LOWER).decode("utf-8", "replace"))
    at, crc = zlib.crc32(f"{doc_id}:".encode()), zlib.crc32
    for k in [k for k, run in enumerate(runs) if not crc(run.encode(), at) % every]:
        run = runs[k]
        cut = crc(run.encode(), at) % len(run)
        runs[k] = run[:cut] + run[cut + 1:]
    return runs


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CHARS,
                least_n: int = LEAST_N, every: int = EVERY) -> DataFrame:
    """(word, n): words of at least ``least`` code points and ``least_n`` occurrences."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = [w for w in seen if len(w) >= least]
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64())], ["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if text:
                    seen.update(occurrences(doc_id, text, least, every))
                    if len(seen) >= HELD:
                        yield out()
                        seen.clear()
        yield out()
    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    return (texts.filter(F.col("t").isNotNull()).mapInArrow(count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n))


def block_words(length: int) -> int:
    """Words of ``length`` code points that a block holds."""
    return max(1, min(BLOCK, BLOCK_CHARS // max(length, 1)))


def _matrices(words: list[str], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points aligned left and aligned right, padded, and the lengths."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<i4")
    width = int(n.max(initial=0))
    left, right = np.full((len(words), width), pad, np.int32), np.full((len(words), width), pad, np.int32)
    place = np.arange(width)
    left[place < n[:, None]] = codes
    right[place >= width - n[:, None]] = codes
    return left, right, n


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading columns in which each row of a equals each row of b."""
    total = np.zeros((len(a), len(b)), np.int32)
    same = np.ones((len(a), len(b)), bool)
    for x, y in zip(a.T, b.T):
        same &= x[:, None] == y
        if not same.any():
            break
        total += same
    return total


def tile(a: list[str], b: list[str] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) one edit apart, and their common prefixes; b None:
    the pairs within a."""
    left_a, right_a, n_a = _matrices(a, -1)
    left_b, right_b, n_b = _matrices(a if b is None else b, -2)
    prefix = _shared(left_a, left_b)
    suffix = _shared(right_a[:, ::-1], right_b[:, ::-1])
    longer = np.maximum(n_a[:, None], n_b)
    near = (prefix + suffix >= longer - 1) & (np.abs(n_a[:, None] - n_b) <= 1)
    if b is None:
        near &= np.arange(len(a))[:, None] < np.arange(len(a))
    i, j = np.nonzero(near)
    return i, j, prefix[i, j]


def near_words(words: DataFrame) -> DataFrame:
    """words (word, n), each word once -> (word, near, near_n), every ordered pair of
    words one edit apart."""
    spark = words.sparkSession
    long_, half = F.col("long"), F.ceil((F.col("long") - 1) / 2).cast("int")
    size = F.char_length("word")
    sides = (words.select("word", "n", size.alias("size"), F.explode(F.array(size, size + 1)).alias("long"))
             .select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("front"))
             .select("word", "n", "long", "front",
                     F.when(F.col("front"), F.substring("word", F.lit(1), half))
                     .otherwise(F.substring("word", -half, half)).alias("part")))
    group = ["long", "front", "part"]
    blocks = F.ceil(F.col("members") / F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_CHARS) / long_))))
    sizes = (sides.groupBy(*group).agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
             .select(*group, blocks.cast("int").alias("blocks")))
    own, other = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"), F.col("other")
    tiles = (sides.join(sizes, group).withColumn("own", own)
             .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
             .select(*group, F.least("own", other).alias("b1"), F.greatest("own", other).alias("b2"),
                     (F.col("own") > other).alias("second"), "word", "n"))
    keys = [*group, "b1", "b2"]
    dealt = tiles.repartition(cpu_partitions(spark), *keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys):
            yield from _tiles(table, starts)
    return dealt.mapInArrow(compare, "word string, near string, near_n long")


def _tiles(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Near pairs of whole tiles; small ones are compared together, and pairs of
    different tiles left out."""
    words, n = table["word"].to_pylist(), table["n"].to_numpy()
    second, front = (table[c].to_numpy(zero_copy_only=False) for c in ("second", "front"))
    b1, b2, longer = (table[c].to_numpy() for c in ("b1", "b2", "long"))
    size = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    first = 0
    found_a, found_b = [], []
    while first < len(starts) - 1:
        last = first + 1
        lo = starts[first]
        if b1[lo] == b2[lo]:
            while last < len(starts) - 1 and starts[last + 1] - lo <= SHARED and b1[starts[last]] == b2[starts[last]]:
                last += 1
            i, j, prefix = tile(words[lo:starts[last]], None)
            i, j = i + lo, j + lo
        else:
            hi = starts[last]
            x, y = lo + np.flatnonzero(~second[lo:hi]), lo + np.flatnonzero(second[lo:hi])
            i, j, prefix = tile([words[k] for k in x], [words[k] for k in y])
            i, j = x[i], y[j]
        half = longer[i] // 2
        keep = ((owner[i] == owner[j]) & (np.maximum(size[i], size[j]) == longer[i])
                & (front[i] | (prefix < half)))
        found_a.append(i[keep])
        found_b.append(j[keep])
        first = last
    if found_a:
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        one, two = np.concatenate((a, b)), np.concatenate((b, a))
        yield pa.RecordBatch.from_arrays(
            [pa.array([words[k] for k in one], pa.string()), pa.array([words[k] for k in two], pa.string()),
             pa.array(n[two], pa.int64())], ["word", "near", "near_n"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) without cycles -> (word, root), the end of each chain, by doubling
    the pointers until none moves."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(now.join(step, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return now


def variant_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CHARS,
                  least_n: int = LEAST_N, every: int = EVERY, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word.

    form: the near word of largest n, ties to the smallest by code point, if its n is
    at least ``ratio`` (over 1) times the word's; else null. As n grows along forms,
    chains end.
    """
    words = written(word_counts(docs, id_col, text_col, least, least_n, every))
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near"))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    enough = -F.col("best.m") >= ratio * F.col("n")
    rows = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n")))
    ends = roots(rows.filter(F.col("form").isNotNull()))
    return rows.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
