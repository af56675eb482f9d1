"""Exact dedup against a persistent digest index.

The index is a table of one row per distinct text (digest, keep_id, n_chars), bucketed and sorted
by digest. A batch is reduced to one candidate per digest before anything is shuffled by key, set
against the index by a sort-merge anti-join that shuffles only the batch (the index side is already
bucketed), and what is new is appended with the same bucketing. DataFrame operations only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, scratch_dir, strip_space

INDEX_COLUMNS = "text_sha256 STRING, keep_id BIGINT, keep_chars BIGINT"


class DigestIndex:
    """A digest index at ``path``. The folder is the state: any session opens it again under a
    table name of its own. ``buckets`` must stay the same for the life of the index."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.table} ({INDEX_COLUMNS}) USING parquet "
                  f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def new_rows(self, candidates: DataFrame) -> DataFrame:
        """Candidates (one per digest) whose digest the index does not hold."""
        return candidates.hint("merge").join(self.rows().select("text_sha256"), "text_sha256", "left_anti")

    def append(self, new: DataFrame) -> None:
        (new.select("text_sha256", "keep_id", "keep_chars").repartition(self.buckets, "text_sha256")
         .write.mode("append").format("parquet").option("path", self.path)
         .bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.table))
        self.spark.catalog.refreshTable(self.table)


def text_digest(text: Column) -> Column:
    """SHA-256 of the text without white space (null: the empty text)."""
    return F.sha2(strip_space(text).cast("binary"), 256)


def exact_dedup(docs: DataFrame, index: DigestIndex, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256. New texts are
    appended to ``index``.

    Of equal texts in the batch the one with the most code points, then the smallest id stays; a
    text that the index already holds keeps the id it was indexed with, so all rows of the batch
    go. ``group_size`` counts rows of the batch. Null text is the empty text; a null id sorts
    last. Rows repeated with the same id and text share the flag ``kept``: use
    :func:`kept_documents` to leave exactly one. An empty table gives no rows.
    """
    narrow = materialize(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("text_sha256"),
        F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("chars")), "exact-digests")
    groups = narrow.groupBy("text_sha256").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"))).alias("best"))
    groups = materialize(groups.select("text_sha256", "group_size", F.col("best.id").alias("keep_id"),
                                       (-F.col("best.c")).alias("keep_chars")), "exact-groups")
    new = materialize(index.new_rows(groups), "exact-new")
    index.append(new)
    held = groups.join(index.rows().select("text_sha256", F.col("keep_id").alias("held_id")), "text_sha256").join(
        new.select("text_sha256", F.lit(True).alias("is_new")), "text_sha256", "left")
    held = held.select("text_sha256", "group_size", F.col("held_id").alias("keep_id"), "keep_chars",
                       F.coalesce("is_new", F.lit(False)).alias("is_new"))
    kept = F.col("is_new") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    return narrow.join(held, "text_sha256").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def kept_documents(docs: DataFrame, index: DigestIndex, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns, exactly one per text that is new to the index."""
    verdicts = exact_dedup(docs, index, id_col=id_col, text_col=text_col).where("kept").select(
        F.col("doc_id").alias("v_id"), F.col("text_sha256").alias("v_sha")).distinct()
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                    F.col(id_col).cast("long").alias("v_id2"), text_digest(F.col(text_col)).alias("v_sha2"),
                    F.coalesce(F.length(text_col), F.lit(0)).alias("v_chars"))
    hit = d.join(verdicts, (F.col("v_sha") == F.col("v_sha2")) & F.col("v_id").eqNullSafe(F.col("v_id2")))
    # rows that repeat id and text: keep one of them, the longest text first
    best = hit.groupBy("v_sha2").agg(F.max_by("row", F.struct("v_chars", F.xxhash64("row"))).alias("row"))
    return best.select("row.*")


def fresh_index(spark: SparkSession, buckets: int = 64) -> DigestIndex:
    """An empty index in the shared scratch folder."""
    return DigestIndex(spark, f"{scratch_dir(spark)}/digest-index-{uuid.uuid4().hex}", buckets)
