"""Phonetic codes.

Tokens come from a JVM regex chain (P1). Soundex and match-rating codex are
pure column expressions. Metaphone and NYSIIS are rule-heavy state machines;
they run as an Arrow-batched pandas UDF over the token arrays (small per-token
helpers, cached per worker), never row-at-a-time.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pyregex as rx

ALGORITHMS = ("soundex", "metaphone", "nysiis", "match_rating_codex")
MIN_TOKEN = 3


def tokens(text: Column) -> Column:
    """Lower, [^\\w\\s] -> ' ', drop digits, squeeze, split, keep len >= 3."""
    t = F.regexp_replace(F.lower(text), rx.SPECIAL, " ")
    t = F.regexp_replace(t, f"{rx.DIGIT}+", "")
    t = rx.squeeze(t)
    return F.filter(rx.split_words(t), lambda w: F.length(w) >= MIN_TOKEN)


def soundex_code(w: Column) -> Column:
    """American soundex; a non A-Z first character is kept as is, like the
    Python library, instead of returning the word (Spark's built-in rule)."""
    first = F.upper(F.substring(w, 1, 1))
    tail = F.substring(F.soundex(F.concat(F.lit("A"), F.substring(w, 2, 1 << 30))), 2, 3)
    return F.when(first.rlike("^[A-Z]$"), F.soundex(w)).otherwise(F.concat(first, tail))


def match_rating_codes(words: Column) -> Column:
    """P5: upper, collapse repeated letters, drop vowels after the first
    letter; more than 6 letters -> first 3 + last 3.

    One pass over the array per step: a lambda's body has no common subexpressions,
    so a step that names the one before it four times would run it four times."""
    u = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(F.upper(w), " ", ""), r"(.)\1+", "$1"))
    u = F.transform(u, lambda w: F.concat(F.substring(w, 1, 1), F.regexp_replace(F.substring(w, 2, 1 << 30), "[AEIOU]", "")))
    return F.transform(u, lambda w: F.when(
        F.length(w) > 6, F.concat(F.substring(w, 1, 3), F.substring(w, -3, 3))).otherwise(w))


def match_rating_code(w: Column) -> Column:
    """P5 of one word."""
    return F.element_at(match_rating_codes(F.array(w)), 1)


# ---------------------------------------------------------------------------
# Metaphone and NYSIIS: published algorithms (Lawrence Philips 1990; New York
# State Identification and Intelligence System 1970), written per token.

_VOWELS = set("AEIOU")


@functools.lru_cache(maxsize=200_000)
def metaphone(word: str) -> str:
    w = "".join(ch for ch in word.upper() if ch.isalpha())
    if not w:
        return ""
    if w[:2] in ("KN", "GN", "PN", "AE", "WR"):
        w = w[1:]
    if w[0] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    out = []
    n = len(w)
    i = 0
    while i < n:
        c = w[i]
        prev = w[i - 1] if i > 0 else ""
        nxt = w[i + 1] if i + 1 < n else ""
        nxt2 = w[i + 2] if i + 2 < n else ""
        if c == prev and c != "C":
            i += 1
            continue
        if c in _VOWELS:
            if i == 0:
                out.append(c)
        elif c == "B":
            if not (prev == "M" and i == n - 1):
                out.append("B")
        elif c == "C":
            if nxt == "I" and nxt2 == "A":
                out.append("X")
            elif nxt == "H":
                out.append("K" if prev == "S" else "X")
                i += 1
            elif nxt in ("I", "E", "Y"):
                if prev != "S":
                    out.append("S")
            else:
                out.append("K")
        elif c == "D":
            if nxt == "G" and nxt2 in ("E", "Y", "I"):
                out.append("J")
                i += 1
            else:
                out.append("T")
        elif c == "G":
            if nxt == "H":  # silent at the end and before a consonant
                if nxt2 and nxt2 in _VOWELS:
                    out.append("K")
                i += 1
            elif nxt == "N" and (i + 2 == n or (nxt2 == "E" and i + 3 < n and w[i + 3] == "D" and i + 4 == n)):
                pass
            elif nxt in ("I", "E", "Y") and prev != "G":
                out.append("J")
            else:
                out.append("K")
        elif c == "H":
            if nxt in _VOWELS and prev not in ("C", "G", "P", "S", "T"):
                out.append("H")
        elif c == "K":
            if prev != "C":
                out.append("K")
        elif c == "P":
            if nxt == "H":
                out.append("F")
                i += 1
            else:
                out.append("P")
        elif c == "Q":
            out.append("K")
        elif c == "S":
            if nxt == "H":
                out.append("X")
                i += 1
            elif nxt == "I" and nxt2 in ("O", "A"):
                out.append("X")
            else:
                out.append("S")
        elif c == "T":
            if nxt == "I" and nxt2 in ("O", "A"):
                out.append("X")
            elif nxt == "H":
                out.append("0")
                i += 1
            elif not (nxt == "C" and nxt2 == "H"):
                out.append("T")
        elif c == "V":
            out.append("F")
        elif c == "W":
            if nxt in _VOWELS:
                out.append("W")
        elif c == "X":
            out.append("KS")
        elif c == "Y":
            if nxt in _VOWELS:
                out.append("Y")
        elif c == "Z":
            out.append("S")
        elif c in ("F", "J", "L", "M", "N", "R"):
            out.append(c)
        i += 1
    return "".join(out)


@functools.lru_cache(maxsize=200_000)
def nysiis(word: str) -> str:
    w = "".join(ch for ch in word.upper() if ch.isalpha())
    if not w:
        return ""
    for a, b in (("MAC", "MCC"), ("KN", "NN"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS")):
        if w.startswith(a):
            w = b + w[len(a):]
            break
    for a, b in (("EE", "Y"), ("IE", "Y"), ("DT", "D"), ("RT", "D"), ("RD", "D"), ("NT", "D"), ("ND", "D")):
        if w.endswith(a):
            w = w[: -len(a)] + b
            break
    key = [w[0]]
    s = list(w)
    i = 1
    while i < len(s):
        c = s[i]
        if c == "E" and i + 1 < len(s) and s[i + 1] == "V":
            s[i:i + 2] = ["A", "F"]
        elif c in _VOWELS:
            s[i] = "A"
        elif c == "Q":
            s[i] = "G"
        elif c == "Z":
            s[i] = "S"
        elif c == "M":
            s[i] = "N"
        elif c == "K":
            if i + 1 < len(s) and s[i + 1] == "N":
                s[i] = "N"
            else:
                s[i] = "C"
        elif c == "S" and s[i + 1:i + 3] == ["C", "H"]:
            s[i:i + 3] = ["S", "S", "S"]
        elif c == "P" and i + 1 < len(s) and s[i + 1] == "H":
            s[i:i + 2] = ["F", "F"]
        elif c == "H" and (s[i - 1] not in _VOWELS or (i + 1 < len(s) and s[i + 1] not in _VOWELS)):
            s[i] = s[i - 1]
        elif c == "W" and s[i - 1] in _VOWELS:
            s[i] = s[i - 1]
        if s[i] != key[-1]:
            key.append(s[i])
        i += 1
    if len(key) > 1 and key[-1] == "S":
        key.pop()
    if len(key) > 1 and key[-2:] == ["A", "Y"]:
        key[-2:] = ["Y"]
    if len(key) > 1 and key[-1] == "A":
        key.pop()
    return "".join(key)


_PY_CODECS = {"metaphone": metaphone, "nysiis": nysiis}


def _codes_udf(name: str):
    fn = _PY_CODECS[name]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def codes(tok: pd.Series) -> pd.Series:
        return tok.map(lambda ws: [fn(w) for w in ws] if ws is not None else None)

    return codes


def encode(text: Column, algorithm: str = "metaphone") -> Column:
    """Codes of the tokens joined by a space, in token order; empty codes
    are skipped. Unknown names fall back to metaphone, like the reference."""
    toks = tokens(text)
    if algorithm == "soundex":
        codes = F.transform(toks, soundex_code)
    elif algorithm == "match_rating_codex":
        codes = match_rating_codes(toks)
    else:
        codes = _codes_udf(algorithm if algorithm in _PY_CODECS else "metaphone")(toks)
    return F.array_join(F.filter(codes, lambda c: c.isNotNull() & (c != "")), " ")


def similarity(codes_a: Column, codes_b: Column) -> Column:
    """Jaccard of the two code sets; 0 when either is empty."""
    a = F.array_distinct(F.split(codes_a, " "))
    b = F.array_distinct(F.split(codes_b, " "))
    a = F.filter(a, lambda x: x != "")
    b = F.filter(b, lambda x: x != "")
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (union == 0), F.lit(0.0)) \
        .otherwise(inter.cast("double") / union)
