"""Table sources (A1, A3) — plain ``spark.read`` so Catalyst prunes columns and pushes filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE_SCHEMA = "msg_id BIGINT, user_id STRING, host STRING, path STRING, ts TIMESTAMP, body STRING"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = MESSAGE_SCHEMA,
                  body_col: str = "body") -> DataFrame:
    """A1: message bodies from parquet, json or raw bytes.

    ``fmt='binaryFile'`` (or a BINARY ``body``) is decoded lossily: invalid UTF-8 sequences become
    U+FFFD, as the reference does for request bodies.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "json":
        df = spark.read.schema(schema).json(path)
    elif fmt == "text":
        df = spark.read.text(path).withColumnRenamed("value", body_col) \
            .withColumn("msg_id", F.monotonically_increasing_id())
    elif fmt == "binaryFile":
        df = spark.read.format("binaryFile").load(path) \
            .select(F.col("path").alias("source"), F.col("content").alias(body_col)) \
            .withColumn("msg_id", F.xxhash64("source"))
    else:
        df = spark.read.format(fmt).load(path)
    if dict(df.dtypes).get(body_col) == "binary":
        df = df.withColumn(body_col, F.make_valid_utf8(F.col(body_col).cast("string")))
    return df


def read_messages_stream(spark: SparkSession, path: str, schema: str = MESSAGE_SCHEMA,
                         fmt: str = "parquet", max_files_per_trigger: int = 64) -> DataFrame:
    """A1 streaming form: the same schema from a file source."""
    return (spark.readStream.format(fmt).schema(schema)
            .option("maxFilesPerTrigger", max_files_per_trigger).load(path))
