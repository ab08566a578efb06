"""Partition counts."""

from __future__ import annotations


def cpu_partitions(spark) -> int:
    """Partition count for CPU-bound steps (pair distances, centroid scans).

    Their cost is per row pair, not per byte, so AQE's size-based coalescing
    would squeeze small-but-heavy inputs into one task. An explicit
    ``repartition(n, keys)`` is kept as is by AQE.
    """
    try:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    except Exception:
        n = 200
    return max(n, spark.sparkContext.defaultParallelism)
