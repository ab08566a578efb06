"""Language identification of whole, possibly mixed texts.

A word's script narrows the languages to those that are written in it; each word
then gets a log-likelihood per language from hashed character trigrams (with
word ends), and Viterbi decoding with a penalty per switch labels the words, so
spans of other languages inside a text come out as spans. A document's language
is the one whose spans hold the most letters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import chars

#: First code points of script ranges, and the scripts.
SCRIPT_RANGES = [
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"),
    (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"),
    (0x20000, "han"), (0x323B0, "other"),
]
SCRIPTS = list(dict.fromkeys(name for _, name in SCRIPT_RANGES))
FEATURES = 1 << 16
#: Bound of the labelled sample: documents per language.
MAX_PER_LANG = 2000
#: Nats that a change of language costs; least share of a language's letters
#: that makes a script one of its own.
SWITCH, OWN_SCRIPT = 12.0, 0.01
SEGMENT = 128
UNKNOWN = "und"


@cache
def scripts() -> np.ndarray:
    """By code point: the script's number."""
    out = np.full(0x110000, SCRIPTS.index("other"), dtype=np.uint8)
    ends = [a for a, _ in SCRIPT_RANGES[1:]] + [0x110000]
    for (a, name), b in zip(SCRIPT_RANGES, ends):
        out[a:b] = SCRIPTS.index(name)
    return out


@dataclass
class Words:
    """The words of some texts: hashed trigrams of each character and word end,
    where words begin and end in them, letters and script of each word, and its
    text."""
    codes: np.ndarray
    features: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    of: np.ndarray
    begins: np.ndarray


def words(texts: list[str]) -> Words:
    """Words are runs of letters and marks that hold a letter."""
    codes, begins = chars.code_points(texts)
    kind = chars.letters()[codes]
    starts, ends = chars.runs(kind > 0)
    total = np.concatenate(([0], np.cumsum(kind == 1)))
    count = total[ends] - total[starts]
    starts, ends, count = starts[count > 0], ends[count > 0], count[count > 0]
    x = np.where(kind > 0, codes, 0).astype(np.uint32)
    one = np.concatenate(([0], x[:-1])).astype(np.uint32)
    two = np.where(one > 0, np.concatenate(([0, 0], x[:-2]))[:len(x)], 0).astype(np.uint32)
    mixed = (x * np.uint32(0x9E3779B1)) ^ (one * np.uint32(0x85EBCA6B)) ^ (two * np.uint32(0xC2B2AE35))
    features = ((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(16)).astype(np.int32)
    of = np.searchsorted(begins, starts, side="right") - 1
    return Words(codes, features, starts, ends, count, scripts()[codes[starts]], of, begins)


def viterbi(scores: np.ndarray, of: np.ndarray, texts: int, switch: float = SWITCH) -> np.ndarray:
    """Best label per word: scores (words, labels) plus -switch per change inside
    a text. Segments of SEGMENT words are decoded in step for every label that
    may stand before them, then joined text by text: exact, and no longer loop
    for long texts than for many."""
    n, k = scores.shape
    if n == 0 or k == 1:
        return np.zeros(n, dtype=np.int64)
    first = np.searchsorted(of, np.arange(texts + 1))
    counts = np.diff(first)
    per_text = -(-counts // SEGMENT)
    owner = np.repeat(np.arange(texts), per_text)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    start = first[owner] + nth * SEGMENT
    length = np.minimum(SEGMENT, first[owner + 1] - start)
    order = np.argsort(-length, kind="stable")
    start, length, owner, nth = start[order], length[order], owner[order], nth[order]
    active = [int(a) for a in np.searchsorted(-length, -np.arange(SEGMENT), side="left")]
    value = np.full((len(start), k, k), -switch)
    value[:, np.arange(k), np.arange(k)] = 0.0
    value += scores[start][:, None, :]
    came, best = [None], [None]
    for t in range(1, int(length[0])):
        v = value[:active[t]]
        top = v.argmax(axis=2)
        jump = np.take_along_axis(v, top[:, :, None], 2) - switch
        came.append(v < jump)
        best.append(top)
        value[:active[t]] = np.maximum(v, jump) + scores[start[:active[t]] + t][:, None, :]
    # join the segments of each text
    where = np.empty(len(start), dtype=np.int64)
    where[np.lexsort((nth, owner))] = np.arange(len(start))
    at = np.argsort(where)  # segment numbers in text order
    base = np.cumsum(per_text) - per_text
    total = np.zeros((texts, k))
    before = np.zeros((len(start), k), dtype=np.int64)
    for j in range(int(per_text.max())):
        who = np.flatnonzero(per_text > j)
        seg = at[base[who] + j]
        both = total[who][:, :, None] + value[seg]
        before[seg] = both.argmax(axis=1)
        total[who] = both.max(axis=1)
    state = total.argmax(axis=1)
    final, lead = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)
    for j in range(int(per_text.max()) - 1, -1, -1):
        who = np.flatnonzero(per_text > j)
        seg = at[base[who] + j]
        final[seg] = state[who]
        lead[seg] = before[seg, state[who]]
        state[who] = lead[seg]
    out, now = np.zeros(n, dtype=np.int64), np.zeros(len(start), dtype=np.int64)
    rows = np.arange(len(start))
    for t in range(int(length[0]) - 1, -1, -1):
        last = active[t + 1] if t + 1 < SEGMENT else 0
        now[last:active[t]] = final[last:active[t]]
        r = rows[:active[t]]
        out[start[r] + t] = now[r]
        if t:
            switched = came[t][r, lead[r], now[r]]
            now[r] = np.where(switched, best[t][r, lead[r]], now[r])
    return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray      # (features, languages) log-likelihoods
    allowed: np.ndarray    # (scripts, languages)

    def block(self) -> int:
        """Characters decoded at once: decoding holds languages ** 2 bytes a word."""
        return max(1 << 12, chars.BLOCK_CHARS * 16 // max(16, len(self.langs) ** 2))

    def decode(self, w: Words, texts: int) -> np.ndarray:
        """The label of each word, of the languages written in its script if there are any."""
        scores = np.empty((len(w.starts), len(self.langs)))
        for i in range(len(self.langs)):
            total = np.concatenate(([0.0], np.cumsum(self.table[w.features, i], dtype=np.float64)))
            scores[:, i] = total[w.ends + 1] - total[w.starts]
        foreign = ~self.allowed & self.allowed.any(axis=1)[:, None]
        scores[foreign[w.script]] = -np.inf
        return viterbi(scores, w.of, texts)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and share of the letters in its spans."""
        langs, share = [], []
        for a, b in chars.blocks(texts, self.block()):
            w, k = words(texts[a:b]), len(self.langs)
            label = self.decode(w, b - a)
            held = np.bincount(w.of * k + label, weights=w.letters, minlength=(b - a) * k).reshape(b - a, k)
            most, all_of = held.argmax(axis=1), held.sum(axis=1)
            langs += [self.langs[m] if n else UNKNOWN for m, n in zip(most.tolist(), all_of.tolist())]
            share.append(held.max(axis=1) / np.maximum(all_of, 1))
        return langs, np.concatenate(share) if share else np.empty(0)

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Of each text: (start, end, language) in characters of its lower case,
        from the first to the last word of each span."""
        out = []
        for a, b in chars.blocks(texts, self.block()):
            w = words(texts[a:b])
            label = self.decode(w, b - a)
            found = [[] for _ in range(b - a)]
            for s, e, d, x in zip(w.starts.tolist(), w.ends.tolist(), w.of.tolist(), label.tolist()):
                s, e = s - int(w.begins[d]), e - int(w.begins[d])
                if found[d] and found[d][-1][2] == self.langs[x]:
                    found[d][-1] = (found[d][-1][0], e, self.langs[x])
                else:
                    found[d].append((s, e, self.langs[x]))
            out += found
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on at most MAX_PER_LANG documents of each non-null language (the
    smallest hashes of their ids), never on held-out ones, of which crc32(id as
    text) mod 3 is 1, or on rows with a null id. Ids whose hash lies under a line
    drawn from the language's number of ids (a sketch, 2 % off) are ranked, about
    twice MAX_PER_LANG, so no task sorts a language. The chosen ids are broadcast (at most MAX_PER_LANG a
    language, less than the model itself), so no text is shuffled. Trigrams and
    scripts are counted on the executors; the driver gets at most FEATURES counts a
    language. None without a labelled letter."""
    thin = (docs.select(F.col(id_col).alias("_i"), F.col(lang_col).cast("string").alias("_l"))
            .filter("_i IS NOT NULL AND _l IS NOT NULL AND crc32(cast(_i AS string)) % 3 <> 1"))
    sizes = thin.groupBy("_l").agg(F.approx_count_distinct("_i", 0.02).alias("_size"))
    share = F.xxhash64("_i").cast("double") / F.lit(2.0 ** 64) + F.lit(0.5)
    near = (thin.join(F.broadcast(sizes), "_l").filter(share * F.col("_size") <= F.lit(2.0 * MAX_PER_LANG))
            .select("_i", "_l").distinct())
    nth = F.row_number().over(Window.partitionBy("_l").orderBy(F.xxhash64("_i"), "_i"))
    picked = near.withColumn("_n", nth).filter(F.col("_n") <= MAX_PER_LANG).select("_i", "_l")
    sample = (docs.select(F.col(id_col).alias("_i"), F.col(lang_col).cast("string").alias("_l"),
                          F.col(text_col).alias("text")).join(F.broadcast(picked), ["_i", "_l"]).select("_l", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lang = chars.decoded(b.column(1)), np.array(b.column(0).to_pylist(), dtype=object)
            for name in dict.fromkeys(lang.tolist()):
                own = [t for t, x in zip(texts, lang) if x == name]
                for i, j in chars.blocks(own):
                    w = words(own[i:j])
                    edge = np.zeros(len(w.features) + 1, dtype=np.int32)
                    edge[w.starts] += 1
                    edge[w.ends + 1] -= 1
                    n = np.bincount(w.features[np.cumsum(edge)[:-1] > 0], minlength=FEATURES)
                    at = np.flatnonzero(n)
                    m = np.bincount(w.script, weights=w.letters, minlength=len(SCRIPTS))
                    own_scripts = np.flatnonzero(m)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * (len(at) + len(own_scripts)), pa.string()),
                         pa.array(np.r_[at, -1 - own_scripts].astype(np.int32)),
                         pa.array(np.r_[n[at], m[own_scripts]].astype(np.int64))], ["lang", "feature", "n"])
    counted = (sample.mapInArrow(count, "lang string, feature int, n long")
               .groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow())
    langs = sorted(set(counted["lang"].to_pylist()))
    if not langs:
        return None
    number = np.array([langs.index(x) for x in counted["lang"].to_pylist()])
    feature, n = counted["feature"].to_numpy(), counted["n"].to_numpy()
    table = np.full((FEATURES, len(langs)), 0.5)
    own = feature >= 0
    np.add.at(table, (feature[own], number[own]), n[own])
    table = np.log(table / table.sum(axis=0)).astype(np.float32)
    held = np.zeros((len(SCRIPTS), len(langs)))
    np.add.at(held, (-1 - feature[~own], number[~own]), n[~own])
    return Model(langs, table, held >= OWN_SCRIPT * np.maximum(held.sum(axis=0), 1))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), one row per input row, from the text alone.

    The score is the share of a text's letters in spans of the predicted
    language. Null texts, texts without a letter and all texts without a model
    are ``und`` with score 0; a tie goes to the first language by name.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, share = model.predict(chars.decoded(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(share)],
                                             ["doc_id", "lang_pred", "score"])
    return rows.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")


def language_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array of struct(start, end, lang)), one row per input row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"start": s, "end": e, "lang": x} for s, e, x in t]
                     for t in model.spans(chars.decoded(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "spans"])
    return rows.mapInArrow(run, f"doc_id {id_type}, spans array<struct<start:int,end:int,lang:string>>")
