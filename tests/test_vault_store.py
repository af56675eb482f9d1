"""The persistent vault, restoration without shuffling bodies that hold no token, audit lookup by user."""
import uuid

import pytest
from pyspark.sql import functions as F

from spanshield.operators import audit as AU
from spanshield.operators import vault as V
from spanshield.operators import vault_store as VS
from spanshield.plans import stream_catalog as SC

SCHEMA = "core string, session_key string, value string, stored_at string, last_access string"


def entries(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.col(c).cast("timestamp") for c in ("stored_at", "last_access")})


@pytest.fixture()
def vault(spark):
    day = "2024-01-01 00:00:00"
    rows = [(f"KEY_{i:016x}", None if i % 3 else f"s{i % 5}", f"v{i}", day, day) for i in range(300)]
    tables = VS.VaultTables(spark, "vault_" + uuid.uuid4().hex, buckets=4)
    tables.create(entries(spark, rows))
    return tables, rows


def content(df):
    return sorted((r.core, r.session_key or "", r.value, str(r.stored_at), str(r.last_access)) for r in df.select(*V.VAULT_COLS).collect())


def test_upserts_merge_on_read_as_the_batch_upsert(spark, vault):
    tables, rows = vault
    base = entries(spark, rows)
    first = entries(spark, [(c, s, v + "!", "2024-01-02 00:00:00", "2024-01-02 00:00:00") for c, s, v, _, _ in rows[::4]])
    second = entries(spark, [("NEW_0000000000000001", None, "new", "2024-01-03 00:00:00", "2024-01-03 00:00:00"),
                             (rows[0][0], rows[0][1], "older", "2023-12-01 00:00:00", "2024-01-05 00:00:00"),
                             (rows[4][0], rows[4][1], "newest", "2024-01-04 00:00:00", "2024-01-04 00:00:00")])
    tables.upsert(first)
    tables.upsert(second)
    want = content(V.write_vault(V.write_vault(base, first), second))
    assert content(tables.read()) == want
    tables.compact()
    assert tables.version() == 1 and content(tables.read()) == want
    assert spark.table(tables._table("global", "log")).count() == 0


def test_reading_the_vault_shuffles_nothing(spark, vault):
    tables, _ = vault
    plan = tables.scope("session")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan, plan


def test_an_upsert_reads_only_its_own_rows(spark, vault, monkeypatch):
    tables, rows = vault
    seen = []
    monkeypatch.setattr(VS.VaultTables, "_append", lambda self, df, scope, table: seen.append(df._jdf.queryExecution().optimizedPlan().toString()))
    tables.upsert(entries(spark, [(rows[0][0], None, "x", "2024-01-02 00:00:00", "2024-01-02 00:00:00")]))
    assert len(seen) == 2 and not any("base" in p for p in seen)


def test_a_failed_compaction_leaves_the_vault_as_it_was(spark, vault, monkeypatch):
    tables, rows = vault
    before = content(tables.read())
    real = VS.VaultTables._append
    done = []

    def failing(self, df, scope, table):
        if len(done) == 3:
            raise OSError("lost")
        done.append(table)
        real(self, df, scope, table)
    monkeypatch.setattr(VS.VaultTables, "_append", failing)
    with pytest.raises(OSError):
        tables.compact()
    monkeypatch.setattr(VS.VaultTables, "_append", real)
    assert tables.version() == 0 and content(tables.read()) == before
    tables.compact()
    assert tables.version() == 1 and content(tables.read()) == before


def test_a_token_read_on_day_29_lives_on_day_31(spark, vault):
    tables, rows = vault
    asked = spark.createDataFrame([(rows[1][0], "any"), (rows[3][0], "s3"), (rows[6][0], "not its session"), ("KEY_ffffffffffffffff", "s1")], "core string, session_key string")
    tables.touch(VS.touched(asked.withColumn("at", F.lit("2024-01-29 00:00:00").cast("timestamp")), tables.scopes()))
    tables.compact(now=F.lit("2024-01-31 12:00:00").cast("timestamp"))
    assert [(c, s) for c, s, *_ in content(tables.read())] == sorted([(rows[1][0], ""), (rows[3][0], "s3")])


def test_restored_from_the_tables(spark, vault):
    tables, rows = vault
    replies = spark.createDataFrame([(1, "s0", f"a [{rows[1][0]}] b"), (2, "s3", f"[{rows[3][0]}]"), (3, "s0", "no token, only a_b"), (4, "s0", None)],
                                    "msg_id long, session_key string, body string")
    got = {r.msg_id: r.restored for r in V.detokenize(replies, tables.scopes()).collect()}
    assert got == {1: "a v1 b", 2: "v3", 3: "no token, only a_b", 4: None}


def test_bodies_without_a_token_meet_no_exchange(spark, vault):
    tables, _ = vault
    path = SC.folder(spark, "replies")
    spark.range(100).select(F.col("id").alias("msg_id"), F.lit("s").alias("session_key"),
                            F.when(F.col("id") < 5, "[KEY_0000000000000001]").otherwise("plain").alias("body")).write.parquet(path)
    out = V.detokenize(spark.read.parquet(path), tables.read())
    lines = out._jdf.queryExecution().executedPlan().toString().split("\n")
    union = next(i for i, line in enumerate(lines) if line.lstrip(" +-").startswith("Union"))
    depth = lines[union].index("Union")
    last = max(i for i, line in enumerate(lines) if line[depth:].startswith("+- "))  # the union's last child and all below it
    assert "Exchange" in "".join(lines[union:last]) and "Exchange" not in "".join(lines[last:]), "\n".join(lines)
    assert out.where("restored = 'plain'").count() == 95 and out.count() == 100


def scanned_rows(df):
    """Rows that the file scans of an executed query gave out, after skipped row groups."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_lookup_by_user_skips_row_groups(spark):
    path = SC.folder(spark, "audit")
    events = spark.range(200_000).select(
        F.concat(F.lit("u"), F.lpad((F.col("id") % 5000).cast("string"), 5, "0")).alias("user_id"), F.lit("host").alias("resource"), F.lit("SECRET").alias("violation_type"),
        F.sha2(F.col("id").cast("string"), 256).alias("masked_context"), F.sha2(F.col("id").cast("string"), 512).alias("token"), F.lit("/p").alias("request_path"),
        F.lit("2024-01-01 10:00:00").cast("timestamp").alias("ts"))
    AU.write_audit(events, path, users=5000, row_group_bytes=1 << 20)
    found = AU.query_audit(AU.read_audit(spark, path), user="u01234")
    assert found.count() == 40
    spark.conf.set("spark.sql.parquet.enableVectorizedReader", "false")
    try:
        assert scanned_rows(AU.query_audit(AU.read_audit(spark, path), user="u01234").select("token")) < 40_000
        assert AU.query_audit(AU.read_audit(spark, path), user="nobody at all").count() == 0
    finally:
        spark.conf.set("spark.sql.parquet.enableVectorizedReader", "true")
