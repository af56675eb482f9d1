"""Sources and sinks: lossy byte decoding, partitioned audit writes with pruning."""
import os
import uuid

from pyspark.sql import functions as F

from spanshield.operators import audit as AU
from spanshield.plans import catalog as C
from spanshield.sources.tables import read_messages


def test_read_messages_binary_is_lossy(spark):
    scratch = os.path.join(spark.conf.get("spark.checkpoint.dir"), "src-" + uuid.uuid4().hex[:8])
    df = spark.createDataFrame([(1, bytearray(b"ok \xff\xfe sk-1234567890abcdefgh"))], "msg_id long, body binary")
    df.write.parquet(scratch)
    m = read_messages(spark, scratch)
    body = m.first().body
    assert "�" in body and "sk-1234567890abcdefgh" in body


def test_write_audit_partitioned_and_pruned(spark, sf_dir):
    path = os.path.join(spark.conf.get("spark.checkpoint.dir"), "audit-" + uuid.uuid4().hex[:8])
    ev = C.violation_events(spark, sf_dir)
    AU.write_audit(ev, path)
    back = AU.read_audit(spark, path)
    assert back.count() == ev.count()
    q = AU.query_audit(back, violation_type="PII_EMAIL")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "violation_type" in plan
    assert "masked_context" in back.columns
    # events never hold the original text
    joined = ev.join(C.c5_tokens(spark, sf_dir), ["msg_id", "ord"])
    assert joined.count() == ev.count()
