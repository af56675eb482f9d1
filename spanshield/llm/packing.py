"""Best-fit packing under conflicts.

Documents are cut into pieces of at most ``capacity`` tokens and dealt by hash into shards of
bounded size; each shard is packed on its own, so the work and the memory of a task do not grow
with the corpus. Inside a shard the largest piece goes first. Open bins are kept ordered by what
they have left; the search starts at the tightest bin that could hold the piece and moves to the
next successor until the bin's source bitmap and duplicate-cluster bitmap both allow it.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

CAPACITY = 2048
SHARD_PIECES = 2048


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) per piece, for pieces in the order given. ``sources`` and ``clusters`` are bit
    masks of what a piece carries (0: conflicts with nothing); a bin never holds a bit twice."""
    order: list[tuple[int, int]] = []          # (left, bin), ascending
    held_sources: list[int] = []
    held_clusters: list[int] = []
    out = []
    for size, s, c in zip(sizes, sources, clusters):
        at = bisect_left(order, (size, -1))
        while at < len(order) and (held_sources[order[at][1]] & s or held_clusters[order[at][1]] & c):
            at += 1
        if at < len(order):
            left, b = order.pop(at)
        else:
            left, b = capacity, len(held_sources)
            held_sources.append(0)
            held_clusters.append(0)
        out.append((b, capacity - left))
        held_sources[b] |= s
        held_clusters[b] |= c
        if left > size:
            insort(order, (left - size, b))
    return out


def _bits(values: pd.Series, alone: bool) -> list[int]:
    """One bit per value; with ``alone`` false a value that occurs once needs none."""
    codes, uniques = pd.factorize(values, use_na_sentinel=False)
    seen = pd.Series(codes).value_counts()
    names: dict[int, int] = {}
    return [0 if not alone and seen[c] < 2 else 1 << names.setdefault(c, len(names)) for c in codes]


def pack(docs: DataFrame, tokens: Column, *, id_col: str = "doc_id", source_col: str = "source",
         cluster: Column | None = None, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: doc_id, copy, piece, piece_start, tokens, bin_id, bin_offset, shard.

    A document of more than ``capacity`` tokens is cut into full pieces and a rest; every token is
    packed exactly once. No bin holds two pieces of one source or of one ``cluster``. A null source
    is a source of its own, a null cluster conflicts with nothing. Documents without tokens get one
    row with a null bin. Repeated rows are counted, told apart by ``copy`` and packed each. Ids may
    be null or repeat. The shard of a piece is a hash of the row, so reruns agree; an empty table
    gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       (cluster if cluster is not None else F.lit(None)).cast("string").alias("cluster"),
                       F.coalesce(tokens, F.lit(0)).cast("long").alias("size"))
    # rows that are equal in everything are counted before they are shuffled, then numbered
    rows = rows.groupBy("doc_id", "source", "cluster", "size").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n")
    last = F.greatest(F.lit(0).cast("long"), F.ceil(F.col("size") / F.lit(capacity)).cast("long") - 1)
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    pieces = pieces.withColumn("piece_start", F.col("piece") * capacity).withColumn(
        "tokens", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece_start"))).drop("size")
    pieces = materialize(pieces, "pack-pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy", "piece", "source", "cluster", "tokens"), F.lit(shards)).cast("int"))

    def pack_shard(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["tokens", "doc_id", "copy", "piece", "source", "cluster"],
                                  ascending=[False, True, True, True, True, True], kind="stable")
        cluster_bits = _bits(shard["cluster"], alone=False)
        cluster_bits = [0 if pd.isna(c) else b for c, b in zip(shard["cluster"], cluster_bits)]
        placed = best_fit(shard["tokens"].tolist(), _bits(shard["source"], alone=True), cluster_bits, capacity)
        shard = shard.drop(columns=["source", "cluster"])
        shard["bin_id"] = [(int(s) << 32) + b for s, (b, _) in zip(shard["shard"], placed)]
        shard["bin_offset"] = [o for _, o in placed]
        return shard[["doc_id", "copy", "piece", "piece_start", "tokens", "bin_id", "bin_offset", "shard"]].astype({"doc_id": "Int64"})

    schema = "doc_id long, copy long, piece long, piece_start long, tokens long, bin_id long, bin_offset long, shard int"
    packed = dealt.where("tokens > 0").groupBy("shard").applyInPandas(pack_shard, schema)
    empty = pieces.where("tokens <= 0").select("doc_id", "copy", "piece", "piece_start", "tokens",
                                              F.lit(None).cast("long").alias("bin_id"),
                                              F.lit(None).cast("long").alias("bin_offset"),
                                              F.lit(None).cast("int").alias("shard"))
    return packed.unionByName(empty)
