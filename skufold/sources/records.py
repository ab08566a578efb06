"""Records of quoted CSV files whose lines are read by many tasks.

A quoted field may hold line ends, so where a record ends depends on all that lies
before it. Each block of a file is first reduced to what it does to the one thing that
matters, being inside or outside a quoted field at its start; prefix compositions of
these small functions over a file's blocks give every block's state. Then each block
cuts its own lines into records. Only records that cross blocks are shuffled: their
pieces are joined by the block in which they begin. Texts are not shuffled else.

Quotes are doubled inside quoted fields; a quote within an unquoted field is text; what
follows a closing quote up to the next comma belongs to the field. A quote that is never
closed runs to the end of its file, as in Spark's multi-line reader. Lines end as a file's
first line does; ends of two characters become one within fields. Blank lines between
records are none. Compressed files are one block. The first record is looked for in
a file's first block.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import saved

_QUOTED = re.compile(r'[^"]*(?:""[^"]*)*')
_BLOCKS = "path string, block long, lines long, end0 boolean, end1 boolean, closes1 boolean, crlf boolean"
_PIECES = "path string, block long, origin long, first boolean, whole boolean, text string"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open after a line that begins inside one or outside."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside or line.startswith('"', at):
            close = _QUOTED.match(line, at if inside else at + 1).end()
            if close == len(line):
                return True
            inside, at = False, close + 1
        at = line.find(",", at) + 1
        if at == 0:
            return False


def _lines(spark: SparkSession, paths) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(paths)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(batches):
    """(path, block, extra columns of its first row, lines) per run of a block's lines in a batch."""
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        start = 0
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or cols[1][i] != cols[1][start] or cols[0][i] != cols[0][start]:
                yield cols[0][start], cols[1][start], [c[start] for c in cols[3:]], cols[2][start:i]
                start = i


def _rows(rows: list, ddl: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(name, types[kind]) for name, kind in (f.split() for f in ddl.split(","))])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _summaries(batches):
    now, found = None, None
    for path, block, _, lines in _runs(batches):
        if (path, block) != now:
            if now:
                yield _rows([(*now, *found)], _BLOCKS)
            now, found = (path, block), [0, False, True, False, block == 0 and lines[0].endswith("\r")]
        for line in lines:
            found[0] += 1
            found[1], found[2] = ends_inside(line, found[1]), ends_inside(line, found[2])
            found[3] |= not found[2]
    if now:
        yield _rows([(*now, *found)], _BLOCKS)


def _block_states(blocks: DataFrame) -> DataFrame:
    """(path, block, inside, origin, crlf): the state at each block's start, the block in
    which the record begins that is open there, and how the file's first line ends. One
    row per block of the files."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    # a block sets the state, keeps it or turns it round
    sets = F.col("end0") == F.col("end1")
    turns = F.sum((F.col("end0") & ~F.col("end1")).cast("long")).over(upto)
    rows = blocks.withColumn("turns", turns).withColumn("set", F.when(sets, F.struct("end0", "turns")))
    last = F.last("set", ignorenulls=True).over(before)
    odd = lambda n: F.pmod(n, F.lit(2)) == 1
    rows = (rows.withColumn("before", F.coalesce(F.max("turns").over(before), F.lit(0))).withColumn("last", last)
            .withColumn("inside", F.coalesce(F.col("last.end0"), F.lit(False)) !=
                        odd(F.col("before") - F.coalesce(F.col("last.turns"), F.lit(0)))))
    begins = F.when(~F.col("inside") | F.col("closes1"), F.col("block"))
    return (rows.withColumn("begins", begins)
            .withColumn("origin", F.when(F.col("inside"), F.last("begins", ignorenulls=True).over(before)))
            .withColumn("crlf", F.max("crlf").over(Window.partitionBy("path")))
            .select("path", "block", "inside", "origin", "crlf"))


def _cut(batches):
    now, held, inside, origin, first, crlf = None, [], False, None, False, False
    rest = lambda: (*now, now[1] if origin is None else origin, first, False, "\n".join(held))
    for path, block, (known, opened, start, ends), lines in _runs(batches):
        out = []
        if (path, block) != now:
            if known is None:
                raise RuntimeError(f"{path} was split otherwise than before: read it again")
            if held:
                out.append(rest())
            now, held, inside, origin, crlf = (path, block), [], opened, start, ends
            first = block == 0
            if first:
                lines[0] = lines[0].removeprefix("\ufeff")
        for line in lines:
            if crlf:
                line = line.removesuffix("\r")
            if not inside and line == "":
                continue
            inside = ends_inside(line, inside)
            held.append(line)
            if not inside:
                out.append((*now, origin, first, origin is None, "\n".join(held)))
                held, origin, first = [], None, False
        if out:
            yield _rows(out, _PIECES)
    if held:
        yield _rows([rest()], _PIECES)


def read_records(spark: SparkSession, paths) -> DataFrame:
    """(path, first, text): the records of CSV files; ``first`` marks a file's header."""
    blocks = saved(_lines(spark, paths).mapInArrow(_summaries, _BLOCKS))
    states = saved(_block_states(blocks).withColumn("known", F.lit(True)))
    # one short row per block of the input, 128 MB by default: 100 TB have 0.8 million
    lines = (_lines(spark, paths).join(F.broadcast(states), ["path", "block"], "left")
             .select("path", "block", "value", "known", "inside", "origin", "crlf"))
    pieces = lines.mapInArrow(_cut, _PIECES)
    over = (pieces.filter("not whole").groupBy("path", "origin")
            .agg(F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", "text"))).alias("ps"))
            .select("path", "first", F.array_join(F.col("ps.text"), "\n").alias("text")))
    return pieces.filter("whole").select("path", "first", "text").union(over)


def fields(text: Column) -> Column:
    """A record's fields as an array: nothing, quoted or not, is null."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(r',("(?:[^"]++|"")*+"[^,]*+|[^,]*+)'), 1)
    inner = lambda x: F.replace(F.regexp_replace(x, r'(?s)^"(.*)"[^"]*\z', "$1"), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda x: F.nullif(F.when(x.startswith('"'), inner(x)).otherwise(x), F.lit("")))
