"""Parallelism guard for CPU-heavy narrow stages (regex scans over text)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str | None = None, min_partitions: int | None = None,
           force: bool = False) -> DataFrame:
    """Hash-repartition ``df`` on ``key`` when it has fewer partitions than the cluster can run.

    A text table stored as one large file (or row group) is read by a single task; the scan
    that follows is pure CPU, so spreading it first is worth one shuffle of the input. On a
    large input (more partitions than ``defaultParallelism``) this is a no-op. ``force`` is for
    inputs known to be one row group (split count overstates the parallelism). Hashing on the
    message id keeps the result deterministic when a lost task is recomputed.
    """
    if df.isStreaming:  # a stream is partitioned by its source; nothing to inspect here
        return df
    spark = df.sparkSession
    try:
        target = min_partitions or spark.sparkContext.defaultParallelism
        current = None if force else df.rdd.getNumPartitions()
    except Exception:  # Spark Connect: no RDD view; fall back to the session's shuffle width
        target = min_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        current = None
    if current is not None and current >= target:
        return df
    return df.repartition(target, key) if key else df.repartition(target)
