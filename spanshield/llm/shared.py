"""Helpers shared by the operators: scratch tables, word expressions, clash-free column names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of characters other than these; the same six everywhere in this subpackage.
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; set to a temporary one only when it
    is unset and the master is local (tests). A cluster without the setting is an error: executors
    would not see a machine-local folder."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="spanshield-scratch-")
        spark.conf.set("spark.checkpoint.dir", current)
    return current.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared scratch folder and read it back: lineage ends
    there, a lost executor costs nothing, and values that several branches use are computed once."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(col: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def strip_space(col: Column) -> Column:
    """The text without any white space (null: empty)."""
    return F.translate(F.coalesce(col, F.lit("")), SPACE_CHARS, "")


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """The ``documents`` table of a data folder, narrowed to ``cols`` if any are given."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*cols) if cols else df
