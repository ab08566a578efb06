"""Arrow batches of sorted rows, group by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


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
