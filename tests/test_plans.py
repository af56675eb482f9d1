"""Plan shape checks: pruning and pushdown reach the scan, the detection scan runs once."""
from pyspark.sql import functions as F

from spanshield.operators.detect import detect, explode_detections
from spanshield.plans import catalog as C
from spanshield.plans import derived


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_column_pruning_reaches_parquet(spark, sf_dir):
    plan = _plan(C.flagship(spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan


def test_filter_pushdown_on_request_log(spark, sf_dir):
    log = derived.request_log(spark, sf_dir).where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in _plan(log)


def test_scan_expression_not_duplicated_under_explode(spark, sf_dir):
    m = derived.messages(spark, sf_dir)
    plan = _plan(explode_detections(detect(m, "body"), keep=["msg_id"]))
    # the e-mail pattern appears once per evaluation of the scan; a pushed-down size() filter would
    # double it
    assert plan.count("[A-Za-z0-9._%+-]+@") == 2  # regexp_extract_all + split, once each
