"""Toxicity by a subsequence string-kernel support vector machine.

Instances are words; a sentence or document is as toxic as its worst word. The
kernel of two words counts the character triples that both contain in order,
with gaps: a triple that spans n characters weighs DECAY ** n, up to SPAN
characters, so inserted characters and other endings keep most of the likeness.
It is divided by each word's norm. Words written in single letters (``i d i o
t``) are joined first; letters parted by one mark (``id.iot``) are scored both joined
and apart, and long units by windows, so that neighbours never thin a word out.

Training: instances are spans of the labelled documents, words and pairs of
neighbouring words, with soft margins. A span weighs as a positive by how far its
share of contexts in clean documents lies under the sample's, and what it lacks of
1 weighs as a negative, so a quotation or a wrong label lowers a weight and never
takes a span out (contexts, not documents, are counted, so copies of a document
count once). Spans are positives if that many toxic contexts are no chance; pairs
are, if neither word is by itself. Toxic documents that the machine then misses
share their blame out evenly among their words that no clean document has, and
words with half a blame or more are positives too, however rare. Landmarks are
drawn from positives and clean words; with K the kernel among landmarks, Nystroem
features are K(x, L) K ** -1/2, and a squared-hinge support vector machine is
fitted on them by Newton steps. Clean spans that the machine scores highest are
added as negatives and the fit is repeated. As the kernel is a sum over triples,
the machine is at last a table of one weight per triple, which scores whole texts
without any list of known words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chars

CLASSES, SPAN, DECAY = 64, 6, 0.7
GAPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
#: Bounds of the labelled sample that the machine is fitted on.
MAX_TOXIC, MAX_CLEAN = 3000, 6000
LANDMARKS, MAX_POSITIVE, MAX_NEGATIVE, ROUNDS = 256, 1500, 6000, 5
#: Positives that are also trained with a character put in, and how often each.
VARIED, VARIANTS = 400, 4
#: Letters in a window of a unit that has more, and from a window to the next.
WINDOW, STEP = 12, 4
#: A missed toxic document of which more words are in no clean one blames none.
BLAMED = 8
#: So many missed toxic documents count as much as one clean one over the line.
ALARM = 3
THRESHOLD = 0.7


@cache
def char_classes() -> np.ndarray:
    """By code point: a-z 1 to 26, other letters and digits 27 to 63, else 0."""
    kind, out = chars.letters(), np.zeros(0x110000, dtype=np.uint8)
    points = np.arange(0x110000)
    out[kind > 0] = (27 + points * 7 % (CLASSES - 27))[kind > 0]
    out[48:58] = 27 + points[48:58] * 7 % (CLASSES - 27)
    out[97:123] = points[97:123] - 96
    return out


@cache
def _spaces() -> np.ndarray:
    """By code point: whether it is white space, in Unicode, or a control character."""
    out = np.zeros(0x110000, dtype=bool)
    out[[i for i in range(0x110000) if i < 33 or chr(i).isspace()]] = True
    return out


def _windows(x: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of given sizes, those of more letters than WINDOW by windows, the last
    one flush with the end; two letters get class 0 on both sides, so that they have
    triples."""
    more = np.maximum(sizes - WINDOW, 0)
    n = -(-more // STEP) + 1
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(sizes) - sizes, n) + np.minimum(k * STEP, np.repeat(more, n))
    x, bounds = _slices(x, at, at + np.repeat(np.minimum(sizes, WINDOW), n))
    two = np.diff(bounds) == 2
    sides = np.concatenate((bounds[:-1][two], bounds[1:][two]))
    return np.insert(x, sides, 0), bounds + 2 * np.concatenate(([0], np.cumsum(two))), np.repeat(of, n)


def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts -> character classes of all units, where each unit begins
    (and the end), and the text each unit belongs to. Units are runs of letters and
    digits; single ones that follow each other are one."""
    codes, begins = chars.code_points(texts)
    x = char_classes()[codes]
    starts, ends = chars.runs(x > 0)
    of = np.searchsorted(begins, starts, side="right") - 1
    lone = ends - starts == 1
    joins = np.r_[False, lone[1:] & lone[:-1] & (starts[1:] - ends[:-1] <= 3) & (of[1:] == of[:-1])][:len(starts)]
    sizes = np.bincount(np.cumsum(~joins) - 1, weights=ends - starts).astype(np.int64) if len(starts) else ends
    return _windows(x[x > 0], sizes, of[~joins])


def glued(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As units(), but only runs of letters parted by one mark each, as one unit."""
    codes, begins = chars.code_points(texts)
    x = char_classes()[codes]
    inside = x > 0
    mark = ~inside & ~_spaces()[codes] & np.r_[False, inside[:-1]] & np.r_[inside[1:], False]
    starts, ends = chars.runs(inside | mark)
    marks = np.concatenate(([0], np.cumsum(mark)))
    some = marks[ends] > marks[starts]
    starts, ends = starts[some], ends[some]
    x, bounds = _slices(x, starts, ends)
    sizes = ends - starts - (marks[ends] - marks[starts])
    return _windows(x[x > 0], sizes, np.searchsorted(begins, starts, side="right") - 1)


def _norms(lengths: np.ndarray) -> np.ndarray:
    total = sum(np.maximum(lengths - b, 0) * (b - 1) * DECAY ** (2 * (b + 1)) for b in range(2, SPAN))
    return np.sqrt(total)


def _triples(x: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each gap: positions where it fits in a unit, the triple, its weight."""
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(x))
    y = x.astype(np.int32)
    for a, b in GAPS:
        at = np.flatnonzero(left > b)
        yield at, (y[at] * CLASSES + y[at + a]) * CLASSES + y[at + b], DECAY ** (b + 1)


def unit_scores(x: np.ndarray, bounds: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """The machine's decision for each unit; units of under 3 letters: -inf."""
    if len(bounds) < 2:
        return np.empty(0)
    each = np.zeros(len(x))
    for at, triple, w in _triples(x, bounds):
        each[at] += w * weights[triple]
    lengths = np.diff(bounds)
    norm = _norms(lengths)
    total = np.concatenate(([0.0], np.cumsum(each)))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(lengths > 2, (total[bounds[1:]] - total[bounds[:-1]]) / norm + bias, -np.inf)


def _slices(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of x, which may overlap, one after the other, and their bounds."""
    bounds = np.concatenate(([0], np.cumsum(ends - starts)))
    return x[np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], ends - starts)], bounds


def phrases(x: np.ndarray, bounds: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As units(), but each two units of a text that follow each other, class 0 between."""
    at = np.flatnonzero(of[1:] == of[:-1])
    parted = np.insert(x, bounds[1:-1], 0) if len(bounds) > 2 else x
    starts = bounds[:-1] + np.arange(len(bounds) - 1)
    return *_slices(parted, starts[at], starts[at + 1] + np.diff(bounds)[at + 1]), of[at]


@dataclass
class Machine:
    """weights by triple, bias of a unit, whether pairs of units are scored too, and
    the line of a document's score:
    score = logistic(slope * (worst - cut) + logit(THRESHOLD))."""
    weights: np.ndarray
    bias: float
    pairs: bool = False
    cut: float = 0.0
    slope: float = 4.0

    def worst(self, texts: list[str]) -> np.ndarray:
        """The highest unit decision of each text; without units -inf."""
        out = np.full(len(texts), -np.inf)
        for a, b in chars.blocks(texts):
            x, bounds, of = units(texts[a:b])
            np.maximum.at(out[a:b], of, unit_scores(x, bounds, self.weights, self.bias))
            x2, bounds2, of2 = glued(texts[a:b])
            np.maximum.at(out[a:b], of2, unit_scores(x2, bounds2, self.weights, self.bias))
            if self.pairs:
                x, bounds, of = phrases(x, bounds, of)
                np.maximum.at(out[a:b], of, unit_scores(x, bounds, self.weights, self.bias))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        line = self.slope * (np.maximum(self.worst(texts), -1e3) - self.cut) + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(line, -500, 500)))


def _flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return np.frombuffer(b"".join(words), dtype=np.uint8), np.concatenate(([0], np.cumsum(lens)))


def _kernel_to(words: list[bytes], used: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Kernel of words to landmarks; table: landmark features by used triple."""
    out = np.zeros((len(words), table.shape[1]))
    for i in range(0, len(words), 500):
        x, bounds = _flat(words[i:i + 500])
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for at, triple, w in _triples(x, bounds):
            k = np.searchsorted(used, triple)
            hit = (k < len(used)) & (used[np.minimum(k, len(used) - 1)] == triple)
            np.add.at(out, i + owner[at[hit]], w * table[k[hit]])
    return out / np.maximum(_norms(np.fromiter(map(len, words), dtype=np.int64)), 1e-9)[:, None]


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps with halving."""
    z1, w = np.hstack((z, np.ones((len(z), 1)))), np.zeros(z.shape[1] + 1)
    ridge = np.r_[np.ones(z.shape[1]), 1e-6]
    value = lambda w: 0.5 * ridge @ w ** 2 + cost @ np.maximum(0, 1 - y * (z1 @ w)) ** 2
    for _ in range(steps):
        on = y * (z1 @ w) < 1
        grad = ridge * w + 2 * z1[on].T @ (cost[on] * (z1[on] @ w - y[on]))
        if np.abs(grad).max() < 1e-6:
            break
        step = np.linalg.solve(np.diag(ridge) + 2 * (z1[on].T * cost[on]) @ z1[on], grad)
        size, now = 1.0, value(w)
        while value(w - size * step) > now and size > 1e-4:
            size /= 2
        w = w - size * step
    return w[:-1], float(w[-1])


def _with_insertions(words: list[bytes], seed: np.random.Generator) -> list[bytes]:
    out = []
    for w in words:
        for _ in range(VARIANTS):
            at = int(seed.integers(1, len(w)))
            out.append(w[:at] + bytes([int(seed.integers(1, CLASSES))]) + w[at:])
    return out


def marking(toxic: np.ndarray, clean: np.ndarray, rate: float, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By span, from its contexts in toxic and in clean documents and the rate of
    toxic ones: its weight as a positive, 1 if it is never in clean documents and 0 if
    as often as any; and whether so many toxic contexts are no chance, ``among`` so
    many spans with as many contexts (Chernoff's bound)."""
    n = np.maximum(toxic + clean, 1)
    share, rate = toxic / n, min(max(rate, 1e-9), 1 - 1e-9)
    weight = np.clip(1 - (1 - share) / (1 - rate), 0, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = (np.where(share > 0, share * np.log(share / rate), 0)
                 + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - rate)), 0))
    return weight, (weight > 0.5) & (toxic > 1) & (np.log(among) - n * apart < math.log(0.5))


def positives(word: list[bytes], toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """The weight of each word as a positive; 0: it is none."""
    lens = np.fromiter(map(len, word), dtype=np.int64, count=len(word))
    often = np.sort(toxic + clean)
    among = len(often) - np.searchsorted(often, toxic + clean)
    weight, sure = marking(toxic, clean, toxic.sum() / max(1, toxic.sum() + clean.sum()), np.maximum(among, 1))
    some = (weight > 0.5) & (toxic > 1) & (lens > 2)
    if not (some & sure).any():  # a small sample: what it holds most of
        sure = toxic * weight >= (toxic * weight)[some].max(initial=0)
    return np.where(some & sure, weight, 0.0)


def fit_words(word: list[bytes], toxic: np.ndarray, clean: np.ndarray, weight: np.ndarray) -> Machine | None:
    """word: classes of a span; in how many contexts of toxic and of clean documents
    it occurs; its weight as a positive. None without positives or negatives."""
    lens = np.fromiter(map(len, word), dtype=np.int64, count=len(word))
    best = np.flatnonzero(weight > 0)
    best = best[np.lexsort((best, -(toxic * weight)[best]))][:MAX_POSITIVE]
    negatives = np.flatnonzero((clean > 0) & (lens > 2))
    if not len(best) or not len(negatives):
        return None
    seed = np.random.default_rng(7)
    hard = negatives[np.lexsort((negatives, -clean[negatives]))][:MAX_NEGATIVE // 3]
    hard = np.union1d(hard, seed.choice(negatives, min(len(negatives), MAX_NEGATIVE // 3), replace=False))
    x, bounds = _flat([word[i] for i in negatives])
    pos = [word[i] for i in best]
    landmarks = pos
    pos = pos + _with_insertions(pos[:VARIED], seed)
    held = np.r_[weight[best], np.repeat(weight[best][:VARIED], VARIANTS)]
    spread = np.unique(np.linspace(0, len(best) - 1, LANDMARKS // 2).astype(int))
    machine = None
    for _ in range(ROUNDS):
        marks = [landmarks[i] for i in spread] + [word[i] for i in seed.choice(hard, min(len(hard), LANDMARKS // 2), replace=False)]
        lx, lb = _flat(marks)
        owner = np.repeat(np.arange(len(marks)), np.diff(lb))
        found = [(owner[at], t, np.full(len(at), w)) for at, t, w in _triples(lx, lb)]
        who, triple, amount = (np.concatenate(c) for c in zip(*found))
        used, col = np.unique(triple, return_inverse=True)
        table = np.zeros((len(used), len(marks)))
        np.add.at(table, (col, who), amount / np.maximum(_norms(np.diff(lb)), 1e-9)[who])
        value, vector = np.linalg.eigh(table.T @ table)
        good = value > 1e-6 * value.max()
        root = vector[:, good] / np.sqrt(value[good])
        neg = [word[i] for i in hard]
        z = np.vstack((_kernel_to(pos, used, table), _kernel_to(neg, used, table))) @ root
        y = np.r_[np.ones(len(pos)), -np.ones(len(neg))]
        cost = np.r_[held * (20.0 / len(pos) * len(neg) ** 0.5), (1 - weight[hard]) * (20.0 / len(neg) ** 0.5)]
        w, bias = _svm(z, y, cost)
        weights = np.zeros(CLASSES ** 3, dtype=np.float32)
        weights[used] = table @ (root @ w)
        machine = Machine(weights, bias, any(b"\0" in word[i].strip(b"\0") for i in best))
        top = unit_scores(x, bounds, weights, bias)
        worst = negatives[np.argsort(-top, kind="stable")[:MAX_NEGATIVE // 4]]
        hard = np.union1d(hard, worst)[-4 * MAX_NEGATIVE:]
    return machine


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ids = (labels.select(F.col("doc_id").alias("_i"), F.col("toxic").cast("int").alias("toxic"))
           .filter("_i IS NOT NULL AND toxic IN (0, 1) AND crc32(cast(_i AS string)) % 3 <> 1")
           .groupBy("_i").agg(F.max("toxic").alias("toxic")))
    order = F.xxhash64("_i")
    picked = (ids.filter("toxic = 1").orderBy(order, "_i").limit(MAX_TOXIC)
              .union(ids.filter("toxic = 0").orderBy(order, "_i").limit(MAX_CLEAN)))
    return docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("text")).join(picked, "_i").select("text", "toxic")


def _line(machine: Machine, at: np.ndarray, label: np.ndarray) -> None:
    """Draw the line between clean and toxic documents where the fewest are on the
    wrong side, a clean one counting as ALARM toxic ones."""
    at = np.maximum(at, -10)
    toxic, clean, steps = np.sort(at[label == 1]), np.sort(at[label == 0]), np.unique(at)
    wrong = np.searchsorted(toxic, steps, "right") + ALARM * (len(clean) - np.searchsorted(clean, steps, "right"))
    low = float(steps[wrong.argmin()]) if len(clean) else -1.0
    low = max(low, machine.bias)  # words of triples that were never seen are harmless
    high = toxic[toxic > low]
    high = float(np.quantile(high, 0.1)) if len(high) else low + 1.0
    machine.cut = low + 0.15 * (high - low)
    machine.slope = 3.0 / max(high - machine.cut, 0.05)


def _digest(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def _words(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    x, bounds, of = units(texts)
    raw = x.tobytes()
    return [raw[s:e] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())], of


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Machine | None:
    """Fit on at most MAX_TOXIC toxic and MAX_CLEAN clean labelled documents
    (the smallest hashes of their ids), never on held-out ones, of which
    crc32(id as text) mod 3 is 1. Words and their contexts are counted on the
    executors; the driver gets one row per distinct word of the sample, and bounded
    numbers of pairs and of blamed words. Rows with a null id, label or another label
    are left out; of several labels of an id the highest counts. None if no span
    marks toxic documents."""
    sample = _sample(docs, labels, id_col, text_col).checkpoint()

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, label = chars.decoded(b.column(0)), np.array(b.column(1).to_pylist(), dtype=np.int32)
            for i, j in chars.blocks(texts):
                word, of = _words(texts[i:j])
                before = [b"" if not k or of[k] != of[k - 1] else word[k - 1] for k in range(len(word))]
                further = [b"" if not k or of[k] != of[k - 1] else before[k - 1] for k in range(len(word))]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.binary()) for c in (word, before, further)), pa.array(label[i:j][of], pa.int32())],
                    ["word", "before", "further", "toxic"])
    spans = sample.mapInArrow(contexts, "word binary, before binary, further binary, toxic int")
    counts = F.sum("t").alias("toxic"), F.sum(F.lit(1) - F.col("t")).alias("clean")
    counted = (spans.filter("length(word) > 2").groupBy("word", "before").agg(F.min("toxic").alias("t"))
               .groupBy("word").agg(*counts).toArrow())
    if not counted.num_rows:
        return None
    counted = counted.sort_by("word")
    words = counted["word"].to_pylist()
    toxic, clean = (np.array(counted[c].to_pylist(), dtype=np.int64) for c in ("toxic", "clean"))
    weight = positives(words, toxic, clean)

    known = F.array(*[F.lit(bytearray(words[i])) for i in np.flatnonzero(weight > 0)]).cast("array<binary>")
    pairs = (spans.filter("length(before) > 0").groupBy("word", "before", "further").agg(F.min("toxic").alias("t"))
             .groupBy(F.concat("before", F.lit(bytearray(1)), "word").alias("pair"), "before", "word").agg(*counts))
    likely = (pairs.filter((F.col("toxic") > 1) & (F.col("toxic") > F.col("clean")) & (F.octet_length("pair") > 3)
                           & ~F.array_contains(known, F.col("word")) & ~F.array_contains(known, F.col("before")))
              .orderBy((F.col("clean") - F.col("toxic")), "pair").limit(4 * MAX_POSITIVE).toArrow())
    rate, total = toxic.sum() / (toxic.sum() + clean.sum()), toxic.sum() + clean.sum()
    t, c = (np.array(likely[n].to_pylist(), dtype=np.int64) for n in ("toxic", "clean"))
    share, sure = marking(t, c, rate, np.maximum(total / np.maximum(t + c, 1), 1))
    if sure.any():
        at = np.flatnonzero(sure)
        ends = sorted({likely[n][int(i)].as_py() for i in at for n in ("word", "before")})
        ends = F.array(*[F.lit(bytearray(w)) for w in ends])
        harmless = (pairs.filter((F.col("clean") > 0) & (F.col("toxic") <= F.col("clean"))
                                 & (F.array_contains(ends, F.col("word")) | F.array_contains(ends, F.col("before"))))
                    .orderBy(F.desc("clean"), "pair").limit(MAX_NEGATIVE).toArrow())
        words += [likely["pair"][int(i)].as_py() for i in at] + harmless["pair"].to_pylist()
        toxic = np.r_[toxic, t[at], np.array(harmless["toxic"].to_pylist(), dtype=np.int64)]
        clean = np.r_[clean, c[at], np.array(harmless["clean"].to_pylist(), dtype=np.int64)]
        weight = np.r_[weight, share[at], np.zeros(harmless.num_rows)]

    def draw(machine: Machine) -> Machine:
        def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(machine.worst(chars.decoded(b.column(0)))), b.column(1)],
                                                 ["worst", "toxic"])
        seen = sample.mapInArrow(worst, "worst double, toxic int").toArrow()
        _line(machine, seen["worst"].to_numpy(), seen["toxic"].to_numpy())
        return machine

    machine = fit_words(words, toxic, clean, weight)
    if machine is not None:
        machine = draw(machine)
    harmless_words = np.sort(np.array([_digest(w) for w, n in zip(words, clean) if n], dtype=np.uint64))

    def blame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = chars.decoded(b.column(0))
            missed = texts if machine is None else [t for t, x in zip(texts, machine.worst(texts)) if x < machine.cut]
            found = []
            for text in missed:
                own = sorted({w for w in _words([text])[0] if len(w) > 2})
                d = np.array([_digest(w) for w in own], dtype=np.uint64)
                at = np.minimum(np.searchsorted(harmless_words, d), max(len(harmless_words) - 1, 0))
                new = [w for w, known in zip(own, harmless_words[at] == d if len(harmless_words) else [False] * len(own))
                       if not known]
                if len(new) <= BLAMED:
                    found += [(w, 1 / len(new)) for w in new]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()),
                                              pa.array([x for _, x in found], pa.float64())], ["word", "share"])
    # equal texts blame once
    blamed = (sample.filter("toxic = 1").select("text").distinct().mapInArrow(blame, "word binary, share double")
              .groupBy("word").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("share"), F.lit(1e-9)))))).alias("share"))
              .filter("share > 0.499").toArrow())
    if blamed.num_rows:
        place = {w: i for i, w in enumerate(words)}
        for w, x in zip(blamed["word"].to_pylist(), blamed["share"].to_pylist()):
            weight[place[w]] = max(weight[place[w]], x)
        machine = fit_words(words, toxic, clean, weight)
        if machine is not None:
            machine = draw(machine)
    return machine


def score(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score double), one row per input row, from the text alone.

    Null and empty texts score as a text without words does, near 0; without a
    machine every score is 0. Other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if machine is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(machine.scores(chars.decoded(b.column(1))))],
                                             ["doc_id", "score"])
    return rows.mapInArrow(run, f"doc_id {id_type}, score double")


def drop_toxic(docs: DataFrame, machine: Machine | None, text_col: str = "text") -> DataFrame:
    """docs' rows, with all columns, whose score is under THRESHOLD."""
    if machine is None:
        return docs
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(machine.scores(chars.decoded(b.column(place))) < THRESHOLD))
    return docs.mapInArrow(run, docs.schema)
