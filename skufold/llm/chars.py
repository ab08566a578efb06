"""Whole texts as arrays of code points, for operators that score characters."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Characters that are worked on at once; a longer text is a block of its own.
BLOCK_CHARS = 1 << 20


@cache
def letters() -> np.ndarray:
    """By code point: 1 for letters, 2 for marks that belong to a word, else 0."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind in "LM":
            out[i] = 1 if kind == "L" else 2
    return out


def decoded(column: pa.Array) -> list[str]:
    """Lower-cased texts; null: empty."""
    raw = column.cast(pa.binary())
    return [(x.as_py() or b"").decode("utf-8", "replace").lower() for x in raw]


def blocks(texts: list[str], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each followed by a line feed, and where each begins."""
    lens = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int32)
    return codes, np.concatenate(([0], np.cumsum(lens)))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
