"""Operational metrics over a request log (H1-H8): grouped aggregates with map-side partials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Latency histogram bucket bounds in seconds (1 ms .. 30 s), then +Inf.
LATENCY_BOUNDS = [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0, 30.0]


def requests_by(log: DataFrame) -> DataFrame:
    """H1: request count by method, target and DPI flag (``inspected``)."""
    return log.groupBy("method", "target", "inspected").agg(F.count(F.lit(1)).alias("requests"))


def bytes_by_direction(log: DataFrame) -> DataFrame:
    """H2: bytes by direction (request = in, response = out)."""
    s = log.select(F.explode(F.array(
        F.struct(F.lit("request").alias("direction"), F.col("bytes_in").alias("bytes")),
        F.struct(F.lit("response").alias("direction"), F.col("bytes_out").alias("bytes")))).alias("x"))
    return s.groupBy("x.direction").agg(F.sum("x.bytes").cast("long").alias("bytes"))


def latency_histogram(log: DataFrame, bounds=LATENCY_BOUNDS) -> DataFrame:
    """H3: per target, cumulative bucket counts (``le_…``), +Inf count and the sum, in one pass."""
    aggs = [F.count_if(F.col("duration_s") <= F.lit(b)).cast("long").alias(f"le_{b:g}".replace(".", "_"))
            for b in bounds]
    return log.groupBy("target").agg(*aggs, F.count(F.lit(1)).alias("le_inf"),
                                     F.sum("duration_s").alias("sum_s"))


def violations_by(events: DataFrame, compat: bool = False) -> DataFrame:
    """H4: violations by (type, target). ``compat=True`` labels every one ``secret`` as the reference does."""
    vtype = F.lit("secret") if compat else F.lower(F.col("violation_type"))
    return events.groupBy(vtype.alias("type"), F.col("resource").alias("target")).agg(F.count(F.lit(1)).alias("violations"))


def file_scans_by(scans: DataFrame) -> DataFrame:
    """H5: attachment scans by (format, outcome)."""
    return scans.groupBy("format", "outcome").agg(F.count(F.lit(1)).alias("scans"))


def active_connections(log: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """H6: open connections after each instant, from +1 (start) / -1 (end) events.

    A running sum over one global order would put every row in one task. This is a two-level
    prefix sum over time buckets, which are a function of the instant alone: net change per instant
    (map-side partials), bucket totals turned into offsets (one row per bucket of the log's time
    span), running sums inside each bucket plus its offset. Choose ``bucket_seconds`` so that a
    bucket's distinct instants fit a task.
    """
    end_ts = F.col("ts") + F.make_interval(secs=F.col("duration_s"))
    deltas = log.select(F.explode(F.array(
        F.struct(F.col("ts").alias("t"), F.lit(1).alias("d")),
        F.struct(end_ts.alias("t"), F.lit(-1).alias("d")))).alias("x")).select("x.t", "x.d")
    bucket = F.floor(F.unix_micros(F.col("t").cast("timestamp")) / F.lit(bucket_seconds * 1_000_000)).alias("bucket")
    # grouped with its bucket as a key of its own: the exchange of the window below is the only other one
    per_t = deltas.groupBy(bucket, "t").agg(F.sum("d").cast("long").alias("d"))
    earlier = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = deltas.groupBy(bucket.alias("b")).agg(F.sum("d").alias("pd")).select(
        "b", F.coalesce(F.sum("pd").over(earlier), F.lit(0)).alias("offset"))
    running = per_t.withColumn("local", F.sum("d").over(Window.partitionBy("bucket").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    return running.join(offsets, F.col("bucket") == F.col("b")).select(
        F.col("t").alias("ts"), (F.col("offset") + F.col("local")).cast("long").alias("active"))


def active_users(log: DataFrame, exact: bool = True) -> DataFrame:
    """H7: distinct users by source (target host)."""
    agg = F.count_distinct("user_id") if exact else F.approx_count_distinct("user_id")
    return log.groupBy("target").agg(agg.cast("long").alias("active_users"))


def errors_by_target(log: DataFrame) -> DataFrame:
    """H8: upstream errors (status >= 500) by target."""
    return log.where(F.col("status") >= 500).groupBy("target").agg(F.count(F.lit(1)).alias("errors"))
