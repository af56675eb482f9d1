"""Connected components of an edge list by alternating stars."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanshield.session import ensure_checkpoint_dir


def _written(df: DataFrame) -> DataFrame:
    """``df`` through a table in the shared folder: lineage ends here."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/components-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Links every neighbour of a node (of the larger ones alone with ``larger``) to the least node of
    its neighbourhood."""
    near = pairs.union(pairs.select("b", "a")) if larger else pairs
    near = near.toDF("node", "other")
    least = near.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    linked = near.join(least, "node")
    if larger:
        linked = linked.where(F.col("other") > F.col("node"))
        return linked.select(F.col("other").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
    out = linked.select(F.col("other").alias("a"), F.col("least").alias("b"))
    return out.union(least.select("node", "least").toDF("a", "b")).where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` of every node of an edge; a component's name is its least node.

    Large and small stars in turn until nothing changes, which takes a number of rounds that grows with
    the logarithm of the longest path. A node with very many neighbours is one group only in the
    aggregation of their minimum, which is partial; joins on it may be split by AQE. Null ends make
    no edge; loops and repeats are fine; an empty table gives no rows."""
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    pairs = ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    loops = pairs.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    pairs = _written(pairs.where("a <> b").distinct())
    mark = None
    while True:
        pairs = _written(_star(_star(pairs, larger=True), larger=False))
        now = pairs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if now == mark:
            break
        mark = now
    named = pairs.toDF("node", "component")
    roots = named.select("component").distinct().select(F.col("component").alias("node"), "component")
    found = named.union(roots)
    return found.union(loops.join(found, "node", "left_anti"))
