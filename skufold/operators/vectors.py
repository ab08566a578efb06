"""Vector arithmetic as JVM column expressions (array<float|double>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: Column) -> Column:
    return x.cast("double")


def euclidean(a: Column, b: Column) -> Column:
    sq = F.zip_with(a, b, lambda x, y: (_d(x) - _d(y)) * (_d(x) - _d(y)))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v))


def manhattan(a: Column, b: Column) -> Column:
    ab = F.zip_with(a, b, lambda x, y: F.abs(_d(x) - _d(y)))
    return F.aggregate(ab, F.lit(0.0), lambda acc, v: acc + v)


def distance(a: Column, b: Column, metric: Column | str = "euclidean") -> Column:
    """Distance under a per-row metric column or a fixed metric name."""
    if isinstance(metric, str):
        return manhattan(a, b) if metric == "manhattan" else euclidean(a, b)
    return F.when(metric == "manhattan", manhattan(a, b)).otherwise(euclidean(a, b))
