"""Spark session helpers.

``get_spark`` is for local runs and tests. On a cluster, build the session the usual way;
the library only reads ``spark.checkpoint.dir`` and never sets it when it is already present.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # a repeated key in a JSON body: the last value wins, the body stays JSON
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # text columns are wide: keep scan splits moderate so one task holds few large messages
    "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
    # small dimension tables (targets, policies, dictionaries) are broadcast; large ones never are
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(app: str = "spanshield", cpus: int | str = "*", shuffle_partitions: int = 8,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("SPANSHIELD_DRIVER_MEMORY", "16g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_json_keys(spark: SparkSession) -> None:
    """Let JSON objects repeat a key (the last value wins) in a session that was built elsewhere."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory, creating a scratch one only when unset.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that setting always wins.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        current = current.get() if current.isDefined() else None
    if not current and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not current:
        current = tempfile.mkdtemp(prefix="spanshield-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current
