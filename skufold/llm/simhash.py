"""SimHash near-duplicates by covering locality-sensitive hashing.

Every document gets a 64-bit fingerprint of its word shingles. Bit i carries a
non-zero code m(i) of radius + 1 bits; table v keeps the bits with odd parity of
m(i) & v. At most ``radius`` differing bits give at most ``radius`` linear
equations, so some table v keeps none of them: every pair within the radius
shares a bucket of some table, without chance.

Inside a bucket only the bits that its table drops can differ. Members are not
paired: each one writes the midpoints it can reach by flipping radius / 2 of
those bits, and a pair is within the radius exactly if it shares a midpoint. A
midpoint's members are all within the radius of each other, so linking them to
their smallest keeps the components exact; there are few of them per midpoint
(65 for radius 2), however large a bucket is. Copies are one fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import keep_by_key, row_key, written

BITS = 64
#: Fixed value: A-Z to a-z, other bytes unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shingle hashes that are counted at once.
BLOCK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Unsigned fingerprint of a text; 0 for a text without words."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        spans = [(0, len(joined))]
    else:
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lens + 1) - 1
        spans = list(zip((ends - lens)[:-shingle + 1 or None].tolist(), ends[shingle - 1:].tolist()))
    ones, h = np.zeros(BITS, dtype=np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(spans), BLOCK):
        hashes = np.array([h(joined[a:b], 42) for a, b in spans[i:i + BLOCK]], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int((2 * ones > len(spans)).astype(np.uint64) @ (np.uint64(1) << np.arange(BITS, dtype=np.uint64)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, row_key, fp long), one row per input row, written once.

    Words are runs of anything but ASCII white space, lower-cased in A-Z;
    shingles join ``shingle`` words by spaces, repeats included (fewer words: one
    shingle of all). Null and empty texts have fingerprint 0. A batch of rows is
    read whole, a text's hashes are counted in blocks.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"),
                       F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in b.column(2)), dtype=np.uint64, count=len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))],
                                             ["doc_id", "row_key", "fp"])
    return written(rows.mapInArrow(run, f"doc_id {id_type}, row_key string, fp long"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def covering_masks(radius: int) -> list[int]:
    """One mask of kept bits per table; there are 2 ** (radius + 1) - 1."""
    codes = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(BITS) if ((i % codes + 1) & v).bit_count() % 2) for v in range(1, codes + 1)]


def near_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct fp longs -> links (src, dst) whose components are those of all
    pairs within ``radius`` differing bits. The radius is even."""
    if radius % 2 or radius < 2:
        raise ValueError("the radius must be 2, 4, ...")
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k"))
                       for i, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.k")
    shared = rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("t", "k")
    rows = rows.join(shared, ["t", "k"], "left_semi")
    steps = F.lit(None)
    for i, m in enumerate(masks):
        free = [1 << b for b in range(BITS) if not m >> b & 1]
        flips = [_signed(sum(c)) for k in range(radius // 2 + 1) for c in combinations(free, k)]
        steps = F.when(F.col("t") == i, F.array(*[F.lit(x).cast("long") for x in flips])).otherwise(steps)
    reach = rows.select("fp", F.explode(F.transform(steps, lambda x: F.col("fp").bitwiseXOR(x))).alias("mid"))
    met = reach.groupBy("mid").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    links = met.select(F.array_min("fps").alias("src"), F.explode("fps").alias("dst")).filter("src <> dst")
    return links.distinct()


def near_groups(thin: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, row_key, fp) -> + component_id (smallest doc_id reachable over
    links, nulls last) and keep_key (row_key of the row that stays)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key"))
    fps = written(thin.groupBy("fp").agg(first.alias("f")))
    comps = connected_components(near_links(fps.select("fp"), radius))
    joined = fps.join(comps.withColumnRenamed("vertex", "fp"), "fp", "left").select(
        "fp", "f", F.coalesce("component", "fp").alias("c"))
    best = joined.groupBy("c").agg(F.min("f").alias("b"))
    by_fp = joined.join(best, "c").select("fp", F.col("b.doc_id").alias("component_id"),
                                          F.col("b.row_key").alias("keep_key"))
    return thin.join(by_fp, "fp").select("doc_id", "row_key", "fp", "component_id", "keep_key")


def near_deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                     radius: int = 2) -> DataFrame:
    """docs' rows, one per group of near-duplicates (the smallest id; null ids
    last; rows that repeat exactly once), with docs' columns."""
    groups = near_groups(fingerprints(docs, id_col, text_col, shingle), radius)
    return keep_by_key(docs, groups.select(F.col("keep_key").alias("_key")), id_col, text_col)
