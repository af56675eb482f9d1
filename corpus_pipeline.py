"""From raw documents to packed training bins: the five stages, each one of the operators.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanshield.llm import exact_dedup, mixing, packing, simhash, toxicity
from spanshield.llm.shared import materialize, word_count

# Compression distances and fingerprints have no counterpart in SQL; tests/llm runs the stages
# against brute force on a fixture instead.
ORACLE_SQL = None


def _beside_text(docs: DataFrame) -> DataFrame:
    """id, text, and the other columns in one struct: what an operator adds cannot clash with them."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select("doc_id", "text", others.alias("others"))


def _unpacked(packed: DataFrame, docs: DataFrame) -> DataFrame:
    return packed.select(*[(F.col("text") if c == "text" else F.col("others").getField(c)).alias(c) for c in docs.columns])


def tox(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labelled two thirds, does not reject. Null and
    empty texts are scored like any other, repeated rows alike; an empty table gives no rows."""
    training = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    model = toxicity.fit_on(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"), training)
    scored = toxicity.toxicity(_beside_text(docs), model, keep_text=True)
    return _unpacked(scored.where(F.col("score") < toxicity.THRESHOLD), docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space: the one with the most
    characters, then the smallest id. Null counts as empty; of fully equal rows one stays."""
    return exact_dedup.kept_documents(docs, exact_dedup.fresh_index(spark))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash, three words, three bits) the one with the smallest id,
    one without an id if none has any; among several the one with the smallest hash of the row.
    Texts without words are one group."""
    found = simhash.near_duplicates(docs, keep_rows=True)
    least = found.where(F.col("row").getField("doc_id").eqNullSafe(F.col("component_id")))
    kept = least.groupBy("root").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: rows repeat where a source is raised, and the row where a
    source's budget ends keeps its first words. Null is a source of its own; documents without words
    take no part in a mix of words and are not in it."""
    return mixing.emit_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins; repeats of a document never share a bin. A document over the
    capacity makes several pieces, one without words none."""
    return packing.pack(docs, word_count(F.col("text")), cluster=F.col("doc_id"))


STAGES = [("toxicity", tox), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{i}")
    return docs
