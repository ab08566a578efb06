"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Fixed value: the white space that separates words in every contract.
WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the shared ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(id_col: Column, text: Column) -> Column:
    """128-bit digest of a row's id and whole text; null and empty differ.

    Rows that repeat exactly share a key; nulls spread by their text, so a null
    id is no hot key.
    """
    return F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("\x01")), F.lit("\x02"),
                          F.coalesce(text, F.lit("\x01"))))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put behind them until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keep_by_key(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of docs whose ``row_key`` is in keys(_key), repeated rows once.

    The join shuffles texts by a unique digest, so no key is hot; rows are
    already together by key when repeats are removed.
    """
    (key,) = fresh(docs, "_llm_key")
    keyed = docs.withColumn(key, row_key(F.col(id_col), F.col(text_col)))
    kept = keyed.join(keys.select(F.col("_key").alias(key)).distinct(), key, "left_semi")
    return kept.dropDuplicates([key]).drop(key)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches of rows sorted by keys without nulls -> tables of whole groups, and the
    rows at which their groups begin, closed by the number of rows. Holds a batch and
    one group."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        change = np.zeros(max(len(table) - 1, 0), bool)
        for key in keys:
            column = table[key].combine_chunks()
            change |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.flatnonzero(change) + 1))
        if starts[-1]:
            yield table.slice(0, starts[-1]), starts
        rest = table.slice(starts[-1])
    if rest is not None and len(rest):
        yield rest, np.array([0, len(rest)])
