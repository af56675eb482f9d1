"""Tables derived deterministically from the driver tables, in Spark and as DuckDB SQL.

The same derivation is written twice, once with the DataFrame API and once as SQL text for the
oracle, so that every checked query reads the driver tables and grows with them.

* ``messages``: ``documents`` as message bodies (user, host, time assigned from ``doc_id``) plus
  the reference's example texts (``sources.fixtures.MESSAGES``).
* ``request_log``: one request per ``events`` row (method, host, path, tokens, bytes, latency).
* ``users``: one user per distinct ``events.user_id`` with role, status and quotas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanshield.functions.parallel import spread
from spanshield.sources.fixtures import fixture_df, fixture_sql
from spanshield.sources.tables import read_table

HOSTS = ["api.openai.com", "api.anthropic.com", "api.deepseek.com:443", "api.qwen.ai",
         "localhost:8080", "example.org", "eu.api.deepseek.com", "10.0.0.5:8080", "172.20.1.1", "httpbin.org:80"]
PATHS = ["/v1/chat/completions", "/api/users", "/api/users/42", "/api/metrics/self",
         "/api/quota/self", "/api/roles/admin", "/api/metrics"]
ROLES = ["admin", "user", "viewer"]
EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC


def _arr(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


# --- messages ----------------------------------------------------------------------------------
def messages(spark: SparkSession, sf_dir: str, with_fixtures: bool = True, extra=()) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    d = docs.select(
        F.col("doc_id").alias("msg_id"),
        F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("u"), (F.col("doc_id") % 50).cast("string"))).alias("user_id"),
        F.element_at(F.array(*[F.lit(h) for h in HOSTS[:4]]), (F.col("doc_id") % 4 + 1).cast("int")).alias("host"),
        F.lit("/v1/chat/completions").alias("path"),
        F.timestamp_seconds(F.lit(EPOCH) + F.col("doc_id") * 60).alias("ts"),
        F.col("text").alias("body"),
        *extra,
    )
    if with_fixtures:
        d = d.unionByName(fixture_df(spark, "messages"))
    # a table that is one file of one row group is read by one task: only then is the text dealt out
    # before the regex-heavy projections; a table of many files is scanned where it is read
    return spread(d, "msg_id", force=True) if len(docs.inputFiles()) <= 1 else d


def messages_sql(with_fixtures: bool = True) -> str:
    sql = f"""(SELECT doc_id AS msg_id,
        CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'u' || CAST(doc_id % 50 AS VARCHAR) END AS user_id,
        ({_arr(HOSTS[:4])})[CAST(doc_id % 4 + 1 AS INTEGER)] AS host,
        '/v1/chat/completions' AS path,
        TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE AS ts,
        text AS body
      FROM documents"""
    if with_fixtures:
        sql += f"\n      UNION ALL SELECT * FROM {fixture_sql('messages')}"
    return sql + ")"


# --- request log ---------------------------------------------------------------------------------
def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    v = F.col("value")
    return ev.select(
        F.col("event_id").alias("req_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        F.col("ts"),
        F.when(F.col("event_type").isin("click", "view"), F.lit("GET")).otherwise(F.lit("POST")).alias("method"),
        F.element_at(F.array(*[F.lit(h) for h in HOSTS]), (F.col("event_id") % len(HOSTS) + 1).cast("int")).alias("host"),
        F.element_at(F.array(*[F.lit(p) for p in PATHS]), (F.col("event_id") % len(PATHS) + 1).cast("int")).alias("path"),
        F.floor(v * 10).cast("long").alias("tok_in"),
        F.floor(v * 3).cast("long").alias("tok_out"),
        F.floor(v * 40).cast("long").alias("bytes_in"),
        F.floor(v * 120).cast("long").alias("bytes_out"),
        (F.floor(v * 1000) / F.lit(100000.0)).alias("duration_s"),
        F.when(F.col("event_type") == "error", F.lit(502)).otherwise(F.lit(200)).cast("int").alias("status"),
    )


def request_log_sql() -> str:
    return f"""(SELECT event_id AS req_id, 'u' || CAST(user_id AS VARCHAR) AS user_id, ts,
        CASE WHEN event_type IN ('click', 'view') THEN 'GET' ELSE 'POST' END AS method,
        ({_arr(HOSTS)})[CAST(event_id % {len(HOSTS)} + 1 AS INTEGER)] AS host,
        ({_arr(PATHS)})[CAST(event_id % {len(PATHS)} + 1 AS INTEGER)] AS path,
        CAST(floor(value * 10) AS BIGINT) AS tok_in,
        CAST(floor(value * 3) AS BIGINT) AS tok_out,
        CAST(floor(value * 40) AS BIGINT) AS bytes_in,
        CAST(floor(value * 120) AS BIGINT) AS bytes_out,
        floor(value * 1000) / 100000.0 AS duration_s,
        CAST(CASE WHEN event_type = 'error' THEN 502 ELSE 200 END AS INTEGER) AS status
      FROM events)"""


# --- users -----------------------------------------------------------------------------------------
def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read_table(spark, sf_dir, "events").select("user_id").distinct()
    u = F.col("user_id")

    def quota(mod: int, base: int, step: int):
        return F.when(u % mod == 0, F.lit(None).cast("long")).otherwise((F.lit(base) + (u % 7) * step).cast("long"))

    return ids.select(
        F.concat(F.lit("u"), u.cast("string")).alias("id"),
        F.concat(F.lit("user"), F.lpad(u.cast("string"), 4, "0")).alias("username"),
        F.when(u % 10 == 9, F.lit("disabled")).otherwise(F.lit("active")).alias("status"),
        F.element_at(F.array(*[F.lit(r) for r in ROLES]), (u % 3 + 1).cast("int")).alias("role"),
        quota(4, 1, 1).alias("quota_req_day"),
        quota(5, 40, 60).alias("quota_tok_in"),
        quota(6, 10, 30).alias("quota_tok_out"),
        quota(3, 200, 300).alias("quota_bytes_in"),
        quota(8, 600, 900).alias("quota_bytes_out"),
    )


def users_sql() -> str:
    def quota(mod: int, base: int, step: int) -> str:
        return f"CASE WHEN user_id % {mod} = 0 THEN NULL ELSE CAST({base} + (user_id % 7) * {step} AS BIGINT) END"
    return f"""(SELECT 'u' || CAST(user_id AS VARCHAR) AS id,
        'user' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS username,
        CASE WHEN user_id % 10 = 9 THEN 'disabled' ELSE 'active' END AS status,
        ({_arr(ROLES)})[CAST(user_id % 3 + 1 AS INTEGER)] AS role,
        {quota(4, 1, 1)} AS quota_req_day,
        {quota(5, 40, 60)} AS quota_tok_in,
        {quota(6, 10, 30)} AS quota_tok_out,
        {quota(3, 200, 300)} AS quota_bytes_in,
        {quota(8, 600, 900)} AS quota_bytes_out
      FROM (SELECT DISTINCT user_id FROM events))"""


# --- login attempts ------------------------------------------------------------------------------
def login_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One login attempt per event: failed when the event is an error."""
    ev = read_table(spark, sf_dir, "events")
    u = F.col("user_id")
    return ev.select(F.col("event_id").alias("attempt_id"), "ts",
                     F.concat(F.lit("user"), F.lpad(u.cast("string"), 4, "0")).alias("username"),
                     F.concat(F.lit("10.0."), (u % 7).cast("string"), F.lit("."), (u % 11).cast("string")).alias("ip"),
                     (F.col("event_type") != "error").alias("ok"))


def login_attempts_sql() -> str:
    return """(SELECT event_id AS attempt_id, ts, 'user' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS username,
        '10.0.' || CAST(user_id % 7 AS VARCHAR) || '.' || CAST(user_id % 11 AS VARCHAR) AS ip,
        event_type <> 'error' AS ok FROM events)"""


def shared_logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One login attempt per event where users come from several addresses and share them; most fail."""
    ev = read_table(spark, sf_dir, "events")
    u = F.col("user_id")
    return ev.select(F.col("event_id").alias("attempt_id"), "ts",
                     F.concat(F.lit("user"), F.lpad(u.cast("string"), 4, "0")).alias("username"),
                     F.concat(F.lit("10.0."), (u % 7).cast("string"), F.lit("."), ((u + F.col("event_id")) % 3).cast("string")).alias("ip"),
                     F.col("event_type").isin("signup", "purchase").alias("ok"))


def shared_logins_sql() -> str:
    return """(SELECT event_id AS attempt_id, ts, 'user' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS username,
        '10.0.' || CAST(user_id % 7 AS VARCHAR) || '.' || CAST((user_id + event_id) % 3 AS VARCHAR) AS ip,
        event_type IN ('signup', 'purchase') AS ok FROM events)"""
