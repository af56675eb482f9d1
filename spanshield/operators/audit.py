"""Audit operators (A4, F1-F4). Events never hold the matched text, only its masked form and token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanshield import patterns as P
from spanshield.functions.spans import explode_spans

AUDIT_COLS = ["user_id", "resource", "violation_type", "masked_context", "token", "request_path", "ts"]


def violation_events(tokenized: DataFrame, det_col: str = "detections", user_col: str = "user_id",
                     resource_col: str = "host", path_col: str = "path", ts_col: str = "ts",
                     id_col: str = "msg_id") -> DataFrame:
    """one event per detection: ``TYPE: masked=… token=…`` (never the original value)."""
    d = F.col("_e")
    return explode_spans(tokenized, det_col, [id_col, user_col, resource_col, path_col, ts_col], pos="ord") \
        .select(id_col, "ord",
                F.col(user_col).alias("user_id"), F.col(resource_col).alias("resource"),
                d["type"].alias("violation_type"),
                F.concat(d["type"], F.lit(": masked="), d["masked"], F.lit(" token="), d["token"]).alias("masked_context"),
                d["token"].alias("token"), F.col(path_col).alias("request_path"), F.col(ts_col).alias("ts"))


def attachment_events(file_dets: DataFrame, user_col: str = "user_id", resource_col: str = "host",
                      ts_col: str = "ts", keep=()) -> DataFrame:
    """F1 for attachments: path ``attachment``, token ``MASK``, masked text as the context."""
    return file_dets.select(*keep, F.col(user_col).alias("user_id"), F.col(resource_col).alias("resource"),
                            F.col("type").alias("violation_type"), F.col("masked").alias("masked_context"),
                            F.lit("MASK").alias("token"), F.lit("attachment").alias("request_path"),
                            F.col(ts_col).alias("ts"))


def audit_batches(events: DataFrame, tick: str = "5 seconds") -> DataFrame:
    """count per (type, resource, user or ``anon``) per tick, plus the tick total."""
    g = (events.groupBy(F.window("ts", tick).alias("w"), "violation_type", "resource",
                        F.coalesce(F.col("user_id"), F.lit(P.ANON_USER)).alias("user"))
         .agg(F.count(F.lit(1)).alias("n")))
    return g.select(F.col("w.start").alias("tick_start"), "violation_type", "resource", "user", "n",
                    F.sum("n").over(Window.partitionBy("w")).alias("tick_total"))


def detection_summary(tokenized: DataFrame, id_col: str = "msg_id", det_col: str = "detections") -> DataFrame:
    """per message with detections, the number of distinct tokens by type and in total. Counted
    inside the row: no shuffle."""
    def distinct(dets: Column) -> Column:
        return F.size(F.array_distinct(F.transform(dets, lambda d: d["core"]))).cast("long")

    def of_type(vtype: str) -> Column:
        return F.filter(F.col("_dets"), lambda d: d["type"] == vtype)

    dets = F.col("_dets")
    counts = [distinct(of_type(t)).alias(lbl.replace("pii_", "")) for t, lbl, _ in P.VIOLATION_TYPES]
    # the generator keeps the optimizer from copying the detection expression into every count
    one = tokenized.select(id_col, F.explode_outer(F.array(det_col)).alias("_dets")).where(F.size("_dets") > 0)
    return one.select(id_col, *counts, distinct(dets).alias("total"))


def query_audit(events: DataFrame, start=None, end=None, user=None, violation_type=None) -> DataFrame:
    """range / equality predicates; on a partitioned audit table these prune files."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col("ts") >= F.lit(start).cast("timestamp"))
        if "day" in events.columns:  # the partition column: whole days outside the range are not read
            cond = cond & (F.col("day") >= F.to_date(F.lit(start).cast("timestamp")))
    if end is not None:
        cond = cond & (F.col("ts") < F.lit(end).cast("timestamp"))
        if "day" in events.columns:
            cond = cond & (F.col("day") <= F.to_date(F.lit(end).cast("timestamp")))
    if user is not None:
        cond = cond & (F.col("user_id") == F.lit(user))
    if violation_type is not None:
        types = [violation_type] if isinstance(violation_type, str) else list(violation_type)
        cond = cond & F.col("violation_type").isin(types)
    return events.where(cond)


def write_audit(events: DataFrame, path: str, mode: str = "append", users: int = 1_000_000, row_group_bytes: int = 32 << 20) -> None:
    """A4: append events, partitioned by day and type (partition pruning for F4). The rebalance splits
    a (day, type) that is too large for one task and merges small ones. Files are sorted by user and
    carry a Bloom filter on it (sized for ``users`` different ones), so a lookup by user reads the row
    groups that hold the user and skips the others."""
    (events.select(*AUDIT_COLS)
     .withColumn("day", F.to_date("ts"))
     .hint("rebalance", "day", "violation_type")
     .sortWithinPartitions("day", "violation_type", "user_id", "ts")
     .write.mode(mode).partitionBy("day", "violation_type")
     .option("parquet.block.size", row_group_bytes)
     .option("parquet.bloom.filter.enabled#user_id", "true")
     .option("parquet.bloom.filter.expected.ndv#user_id", users).option("parquet.bloom.filter.adaptive.enabled", "true")
     .parquet(path))


def read_audit(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
