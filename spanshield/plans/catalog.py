"""Registry of checked queries: ``name -> (spark builder, DuckDB oracle SQL or None)``.

Every query reads the driver tables (or tables Spark derives from them) in full; fixture rows are
only ever *added* to driver rows. Column names are aliased identically on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanshield.functions.spans import explode_spans
from spanshield.operators import detect as D
from spanshield.plans import derived
from spanshield.plans import oracle_sql as O
from spanshield.session import ensure_checkpoint_dir

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return wrap


MSG_SRC = f"(SELECT msg_id AS id, body AS text FROM {derived.messages_sql()})"
SPAN_COLS = ["msg_id", "start", "end", "type", "text", "masked"]


def _single(detector: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = derived.messages(spark, sf_dir)
        col = D.DETECTORS[detector](F.col("body"))
        return D.explode_detections(m.select("msg_id", col.alias("detections")), keep=["msg_id"]).select(*SPAN_COLS)
    return build


def _single_sql(key: str) -> str:
    ctes = O.detector_ctes("src")
    body = O.greedy_self(ctes[key]) if key == "b1" else ctes[key]
    return (f"WITH src AS (SELECT * FROM {MSG_SRC}) SELECT id AS msg_id, CAST(start AS INTEGER) AS start, "
            f"CAST(\"end\" AS INTEGER) AS \"end\", type, text, masked FROM {body}")


for _name, _det, _key in [("b1_secret_prefix", "secret_prefix", "b1"), ("b2_secret_kv", "secret_kv", "b2"),
                          ("b3_api_key", "api_key", "b3"), ("b4_fio", "fio", "b4"),
                          ("b5_email", "email", "b5"), ("b6_phone", "phone", "b6")]:
    register(_name, _single_sql(_key))(_single(_det))


@register("b8_scan", f"SELECT id AS msg_id, ord, start, \"end\", type, text, masked FROM ({O.scan_sql(MSG_SRC)})")
def b8_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = D.detect(derived.messages(spark, sf_dir), "body")
    return D.explode_detections(m, keep=["msg_id"])


# --- C: rewriting ---------------------------------------------------------------------------------
from spanshield.operators import rewrite as R  # noqa: E402
from spanshield.operators import vault as V  # noqa: E402
from spanshield.operators import vault_store as VS  # noqa: E402
from spanshield.sources.fixtures import fixture_df, fixture_sql  # noqa: E402

MSG_SQL = derived.messages_sql()
SCAN_SQL = f"({O.scan_sql(MSG_SRC)})"
TOKENS_SQL = O.tokens_sql(MSG_SQL)


@register("c1_mask_text", f"""SELECT r.id AS msg_id, r.masked_body, CAST(coalesce(n.n, 0) AS INTEGER) AS n_detections
  FROM {O.rebuild_sql(MSG_SRC, f'(SELECT id, start, "end", masked AS repl FROM {SCAN_SQL})', 'masked_body')} r
  LEFT JOIN (SELECT id, count(*) AS n FROM {SCAN_SQL} GROUP BY id) n ON n.id = r.id""")
def c1_mask_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.mask_text(derived.messages(spark, sf_dir), "body", out="masked_body")
    return m.select("msg_id", "masked_body", F.size("detections").alias("n_detections"))


def tokenized_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tokenize(derived.messages(spark, sf_dir), "body", "user_id", "host")


@register("c5_tokens", f"""SELECT msg_id, ord, type, session_key, '[' || core || ']' AS token, core FROM {TOKENS_SQL}""")
def c5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokenized_messages(spark, sf_dir)
    return explode_spans(t, "detections", ["msg_id", "session_key"], pos="ord") \
        .select("msg_id", "ord", F.col("_e.type").alias("type"), "session_key",
                F.col("_e.token").alias("token"), F.col("_e.core").alias("core"))


TOKENIZED_SQL = O.rebuild_sql(MSG_SRC, f"""(SELECT msg_id AS id, start, "end", '[' || core || ']' AS repl FROM {TOKENS_SQL})""", "tokenized")


@register("c5_tokenized_body", f"SELECT id AS msg_id, tokenized FROM {TOKENIZED_SQL}")
def c5_tokenized_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized_messages(spark, sf_dir).select("msg_id", "tokenized")


# --- D: vault and restoration ------------------------------------------------------------------
ENTRIES_SQL = f"(SELECT msg_id, ts, session_key, ord, core, text AS value, type, hash FROM {TOKENS_SQL})"


def vault_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.token_entries(tokenized_messages(spark, sf_dir))


def tokenized_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokenized messages as a written table, for queries that read it more than once."""
    return stored(tokenized_messages(spark, sf_dir).select("msg_id", "session_key", "ts", "detections", "tokenized"), "tokenized")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder, computed once."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replies_of(tokenized: DataFrame) -> DataFrame:
    """Model replies: the tokenized messages echoed back, plus replies with every token form."""
    t = tokenized.select("msg_id", "session_key", F.col("tokenized").alias("body"))
    return t.unionByName(fixture_df(tokenized.sparkSession, "token_replies"))


VAULT_SQL = f"""(
  SELECT core, CAST(NULL AS VARCHAR) AS session_key, value, stored_at, stored_at AS last_access FROM (
    SELECT core, value, max(ts) OVER (PARTITION BY core) AS stored_at,
           min(value) OVER (PARTITION BY core) = max(value) OVER (PARTITION BY core) AS one,
           row_number() OVER (PARTITION BY core ORDER BY ts DESC, msg_id DESC, ord DESC) AS rn FROM {ENTRIES_SQL}) WHERE rn = 1 AND one
  UNION ALL
  SELECT core, session_key, value, stored_at, stored_at AS last_access FROM (
    SELECT core, session_key, value, max(ts) OVER (PARTITION BY session_key, core) AS stored_at,
           row_number() OVER (PARTITION BY session_key, core ORDER BY ts DESC, msg_id DESC, ord DESC) AS rn FROM {ENTRIES_SQL}) WHERE rn = 1)"""


@register("d1_build_vault", f"SELECT * FROM {VAULT_SQL}")
def d1_build_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.build_vault(vault_entries(spark, sf_dir))


@register("d8_vault_collisions", f"""SELECT core, count(DISTINCT value) AS n_values, count(DISTINCT hash) AS n_hashes
  FROM {ENTRIES_SQL} GROUP BY core HAVING count(DISTINCT value) > 1""")
def d8_vault_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.vault_collisions(vault_entries(spark, sf_dir))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies_of(tokenized_messages(spark, sf_dir))


REPLIES_SQL = f"""(SELECT t.id AS msg_id, m.skey AS session_key, t.tokenized AS body FROM {TOKENIZED_SQL} t
  JOIN (SELECT msg_id, 'map:session:' || coalesce(user_id, 'anon') || ':' || host AS skey FROM {MSG_SQL}) m ON m.msg_id = t.id
  UNION ALL SELECT * FROM {fixture_sql('token_replies')})"""
REPLY_SRC = f"(SELECT msg_id AS id, body AS text FROM {REPLIES_SQL})"


@register("d3_find_tokens", f"""SELECT id AS msg_id, ord, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end",
  token_text, core FROM {O.find_tokens_sql(REPLY_SRC)}""")
def d3_find_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.explode_tokens(replies(spark, sf_dir), "body")


def _detok_sql(unknown_redacted: bool) -> str:
    fallback = "'[REDACTED]'" if unknown_redacted else "t.token_text"
    spans = f"""(SELECT t.id, t.start, t."end", coalesce(g.value, s.value, {fallback}) AS repl
      FROM {O.find_tokens_sql(REPLY_SRC)} t
      JOIN {REPLIES_SQL} r ON r.msg_id = t.id
      LEFT JOIN (SELECT core, value FROM {VAULT_SQL} WHERE session_key IS NULL) g ON g.core = t.core
      LEFT JOIN (SELECT core, session_key, value FROM {VAULT_SQL} WHERE session_key IS NOT NULL) s
        ON s.core = t.core AND s.session_key = r.session_key)"""
    return f"SELECT id AS msg_id, restored FROM {O.rebuild_sql(REPLY_SRC, spans, 'restored')}"


def _detok(unknown):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        tokenized = tokenized_table(spark, sf_dir)
        vault = V.build_vault(V.token_entries(tokenized))
        return V.detokenize(replies_of(tokenized), vault, unknown=unknown).select("msg_id", "restored")
    return build


register("d5_detokenize", _detok_sql(True))(_detok(R.P.REDACTED))
register("d6_detokenize_known", _detok_sql(False))(_detok(None))


@register("d2_expire_vault", f"""SELECT * FROM {VAULT_SQL}
  WHERE last_access >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 30 DAY + INTERVAL 1 DAY""")
def d2_expire_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    vault = V.build_vault(vault_entries(spark, sf_dir))
    now = F.lit("2024-01-16 00:00:00").cast("timestamp")
    return V.expire_vault(vault, now)


_NEARLY_30_DAYS_ON = "2024-01-31 04:00:00"


@register("d2_expire_partly", f"SELECT * FROM {VAULT_SQL} WHERE last_access >= TIMESTAMP '{_NEARLY_30_DAYS_ON}' - INTERVAL 30 DAY")
def d2_expire_partly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of the first hours are gone, the later ones stay."""
    return V.expire_vault(V.build_vault(vault_entries(spark, sf_dir)), F.lit(_NEARLY_30_DAYS_ON).cast("timestamp"))


@register("d2_expire_scopes", f"""SELECT core, session_key, value, stored_at, last_access FROM (
    SELECT *, max(last_access) OVER (PARTITION BY session_key) AS newest FROM {VAULT_SQL})
  WHERE newest >= TIMESTAMP '{_NEARLY_30_DAYS_ON}' - INTERVAL 30 DAY""")
def d2_expire_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scope lives as long as its newest entry."""
    return V.expire_vault(V.build_vault(vault_entries(spark, sf_dir)), F.lit(_NEARLY_30_DAYS_ON).cast("timestamp"), hash_ttl=True)


@register("d8_collisions_found", f"""SELECT left(core, 5) AS core, count(DISTINCT value) AS n_values, count(DISTINCT hash) AS n_hashes
  FROM {ENTRIES_SQL} GROUP BY left(core, 5) HAVING count(DISTINCT value) > 1""")
def d8_collisions_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on tokens cut to one hex digit, where values do collide."""
    return V.vault_collisions(vault_entries(spark, sf_dir).withColumn("core", F.substring("core", 1, 5)))


A5_SQL = f"""SELECT core, session_key, value, stored_at, last_access FROM (
  SELECT core, session_key, value, max(stored_at) OVER w AS stored_at, max(last_access) OVER w AS last_access,
         row_number() OVER (PARTITION BY session_key, core ORDER BY stored_at DESC, value DESC) AS rn
  FROM (SELECT * FROM {VAULT_SQL}
        UNION ALL SELECT core, session_key, upper(value) AS value, stored_at + INTERVAL 1 HOUR AS stored_at,
                         stored_at + INTERVAL 1 HOUR AS last_access FROM {VAULT_SQL} WHERE left(core, 3) = 'EML')
  WINDOW w AS (PARTITION BY session_key, core)) WHERE rn = 1"""


def email_updates(vault: DataFrame) -> DataFrame:
    """Every e-mail entry stored anew an hour later, in capitals."""
    later = F.col("stored_at") + F.expr("INTERVAL 1 HOUR")
    return vault.where(F.left(F.col("core"), F.lit(3)) == "EML").select(
        "core", "session_key", F.upper("value").alias("value"), later.alias("stored_at"), later.alias("last_access"))


@register("a5_write_vault", A5_SQL)
def a5_write_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    vault = V.build_vault(vault_entries(spark, sf_dir))
    return V.write_vault(vault, email_updates(vault))


def new_vault(spark: SparkSession, vault: DataFrame) -> VS.VaultTables:
    tables = VS.VaultTables(spark, f"vault_{uuid.uuid4().hex}", buckets=8)
    tables.create(vault.withColumns({c: F.col(c).cast("timestamp") for c in ("stored_at", "last_access")}))
    return tables


def _as_before(spark: SparkSession, vault: DataFrame, like: DataFrame) -> DataFrame:
    return vault.withColumns({c: F.col(c).cast(like.schema[c].dataType) for c in ("stored_at", "last_access")})


@register("a5_vault_table", A5_SQL)
def a5_vault_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same upsert on the persistent vault: appended to its log, merged on read."""
    vault = V.build_vault(V.token_entries(tokenized_table(spark, sf_dir)))
    tables = new_vault(spark, vault)
    tables.upsert(email_updates(tables.read()))
    return _as_before(spark, tables.read(), vault)


READ_AT, EXPIRED_AT = "2024-01-29 12:00:00", "2024-01-31 06:00:00"


@register("d2_refresh_on_read", f"""WITH v AS {VAULT_SQL}, asked AS (
    SELECT DISTINCT t.core, r.session_key FROM {O.find_tokens_sql(REPLY_SRC)} t JOIN {REPLIES_SQL} r ON r.msg_id = t.id WHERE r.msg_id % 3 = 0),
  hit AS (SELECT DISTINCT core, CAST(NULL AS VARCHAR) AS session_key FROM asked WHERE core IN (SELECT core FROM v WHERE session_key IS NULL)
          UNION ALL SELECT core, session_key FROM asked WHERE core NOT IN (SELECT core FROM v WHERE session_key IS NULL))
  SELECT * FROM (SELECT v.core, v.session_key, v.value, v.stored_at,
    CASE WHEN hit.core IS NOT NULL THEN greatest(v.last_access, TIMESTAMP '{READ_AT}') ELSE v.last_access END AS last_access
    FROM v LEFT JOIN hit ON hit.core = v.core AND hit.session_key IS NOT DISTINCT FROM v.session_key)
  WHERE last_access >= TIMESTAMP '{EXPIRED_AT}' - INTERVAL 30 DAY""")
def d2_refresh_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third reply is restored on day 29; what it read outlives day 30, the rest goes."""
    tokenized = tokenized_table(spark, sf_dir)
    vault = V.build_vault(V.token_entries(tokenized))
    tables = new_vault(spark, vault)
    asked = V.explode_tokens(replies_of(tokenized).where(F.pmod("msg_id", F.lit(3)) == 0), "body", keep=("msg_id", "session_key"))
    tables.touch(VS.touched(asked.withColumn("at", F.lit(READ_AT).cast("timestamp")), tables.scopes()))
    tables.compact(now=F.lit(EXPIRED_AT).cast("timestamp"))
    return _as_before(spark, tables.read(), vault)


# --- F: audit ---------------------------------------------------------------------------------------
from spanshield.operators import access as AC  # noqa: E402
from spanshield.operators import audit as AU  # noqa: E402
from spanshield.operators import metrics as ME  # noqa: E402
from spanshield.operators import usage as US  # noqa: E402

EVENTS_SQL = f"""(SELECT t.msg_id, t.ord, m.user_id, m.host AS resource, t.type AS violation_type,
    t.type || ': masked=' || t.masked || ' token=[' || t.core || ']' AS masked_context, '[' || t.core || ']' AS token,
    m.path AS request_path, m.ts FROM {TOKENS_SQL} t JOIN {MSG_SQL} m ON m.msg_id = t.msg_id)"""


def violation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AU.violation_events(tokenized_messages(spark, sf_dir))


@register("f1_violation_events", f"SELECT * FROM {EVENTS_SQL}")
def f1_violation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violation_events(spark, sf_dir)


@register("f2_audit_batches", f"""SELECT tick_start, violation_type, resource, "user", n, sum(n) OVER (PARTITION BY tick_start) AS tick_total
  FROM (SELECT time_bucket(INTERVAL 5 SECOND, ts) AS tick_start, violation_type, resource, coalesce(user_id, 'anon') AS "user",
               count(*) AS n FROM {EVENTS_SQL} GROUP BY ALL)""")
def f2_audit_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AU.audit_batches(violation_events(spark, sf_dir))


@register("f3_detection_summary", f"""SELECT msg_id,
  count(DISTINCT CASE WHEN type = 'SECRET' THEN core END) AS secret, count(DISTINCT CASE WHEN type = 'PII_FIO' THEN core END) AS fio,
  count(DISTINCT CASE WHEN type = 'PII_COMPANY' THEN core END) AS company, count(DISTINCT CASE WHEN type = 'PII_EMAIL' THEN core END) AS email,
  count(DISTINCT CASE WHEN type = 'PII_PHONE' THEN core END) AS phone, count(DISTINCT core) AS total FROM {TOKENS_SQL} GROUP BY msg_id""")
def f3_detection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AU.detection_summary(tokenized_messages(spark, sf_dir))


@register("f4_query_audit", f"""SELECT * FROM {EVENTS_SQL} WHERE ts >= TIMESTAMP '2024-01-01 03:00:00'
  AND ts < TIMESTAMP '2024-01-01 15:00:00' AND violation_type IN ('SECRET', 'PII_EMAIL')""")
def f4_query_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AU.query_audit(violation_events(spark, sf_dir), "2024-01-01 03:00:00", "2024-01-01 15:00:00",
                          violation_type=["SECRET", "PII_EMAIL"])


@register("a4_write_audit", f"SELECT user_id, resource, violation_type, masked_context, token, request_path, ts FROM {EVENTS_SQL}")
def a4_write_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written to a new audit table in the shared folder and read back."""
    from uuid import uuid4

    from spanshield.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark)}/audit-{uuid4().hex}"
    AU.write_audit(violation_events(spark, sf_dir), path)
    return AU.read_audit(spark, path).select(*AU.AUDIT_COLS)


# --- G: usage, quotas, reports -----------------------------------------------------------------
LOG_SQL = derived.request_log_sql()
USERS_SQL = derived.users_sql()
USAGE_SQL = f"""(SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS req, CAST(sum(tok_in) AS BIGINT) AS tok_in,
  CAST(sum(tok_out) AS BIGINT) AS tok_out, CAST(sum(bytes_in) AS BIGINT) AS bytes_in, CAST(sum(bytes_out) AS BIGINT) AS bytes_out
  FROM {LOG_SQL} GROUP BY user_id, CAST(ts AS DATE))"""
TOTALS_SQL = f"""(SELECT user_id, CAST(coalesce(sum(req), 0) AS BIGINT) AS req, CAST(coalesce(sum(tok_in), 0) AS BIGINT) AS tok_in,
  CAST(coalesce(sum(tok_out), 0) AS BIGINT) AS tok_out, CAST(coalesce(sum(bytes_in), 0) AS BIGINT) AS bytes_in,
  CAST(coalesce(sum(bytes_out), 0) AS BIGINT) AS bytes_out FROM {USAGE_SQL} GROUP BY user_id)"""
REPORT_DAY = "2024-01-15"
TODAY_SQL = f"(SELECT * FROM {USAGE_SQL} WHERE day = DATE '{REPORT_DAY}')"


def _usage(spark, sf_dir):
    return US.usage_daily(derived.request_log(spark, sf_dir))


def _today(spark, sf_dir):
    return _usage(spark, sf_dir).where(F.col("day") == F.lit(REPORT_DAY).cast("date"))


register("g3_usage_daily", f"SELECT * FROM {USAGE_SQL}")(lambda spark, sf_dir: _usage(spark, sf_dir))
register("g4_usage_total", f"SELECT * FROM {TOTALS_SQL}")(lambda spark, sf_dir: US.usage_total(_usage(spark, sf_dir)))


@register("g5_usage_on_day", f"""SELECT u.id AS user_id, coalesce(d.req, 0) AS req, coalesce(d.tok_in, 0) AS tok_in,
  coalesce(d.tok_out, 0) AS tok_out, coalesce(d.bytes_in, 0) AS bytes_in, coalesce(d.bytes_out, 0) AS bytes_out
  FROM {USERS_SQL} u LEFT JOIN {TODAY_SQL} d ON d.user_id = u.id""")
def g5_usage_on_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return US.usage_on_day(derived.users(spark, sf_dir), _usage(spark, sf_dir), REPORT_DAY)


def fmt_tokens_sql(x: str) -> str:
    return (f"(CASE WHEN {x} < 1000 THEN CAST({x} AS VARCHAR) WHEN {x} < 1000000 THEN printf('%.1fK', {x} / 1000.0) "
            f"ELSE printf('%.1fM', {x} / 1000000.0) END)")


def fmt_bytes_sql(x: str) -> str:
    return (f"(CASE WHEN {x} < 1024 THEN CAST({x} AS VARCHAR) || ' B' WHEN {x} < 1048576 THEN printf('%.1f KB', {x} / 1024.0) "
            f"WHEN {x} < 1073741824 THEN printf('%.1f MB', {x} / 1048576.0) WHEN {x} < 1099511627776 THEN printf('%.1f GB', {x} / 1073741824.0) "
            f"ELSE printf('%.1f TB', {x} / 1099511627776.0) END)")


@register("g6_user_metrics", f"""SELECT u.id, u.username, u.status, u.role, coalesce(t.req, 0) AS req, coalesce(t.tok_in, 0) AS tok_in,
  coalesce(t.tok_out, 0) AS tok_out, coalesce(t.bytes_in, 0) AS bytes_in, coalesce(t.bytes_out, 0) AS bytes_out,
  {fmt_tokens_sql('coalesce(t.tok_in, 0)')} AS tok_in_fmt, {fmt_tokens_sql('coalesce(t.tok_out, 0)')} AS tok_out_fmt,
  {fmt_bytes_sql('coalesce(t.bytes_in, 0)')} AS bytes_in_fmt, {fmt_bytes_sql('coalesce(t.bytes_out, 0)')} AS bytes_out_fmt
  FROM {USERS_SQL} u LEFT JOIN {TOTALS_SQL} t ON t.user_id = u.id ORDER BY u.username""")
def g6_user_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return US.user_metrics(derived.users(spark, sf_dir), _usage(spark, sf_dir))


def quota_status_sql(u: str, d: str) -> str:
    parts = [f"WHEN {u}.{qc} IS NOT NULL AND coalesce({d}.{uc}, 0) >= {u}.{qc} THEN '{name}'"
             for name, qc, uc in zip(US.QUOTA_NAMES, US.QUOTA_COLS, US.USAGE_METRICS)]
    return "(CASE " + " ".join(parts) + " ELSE 'ok' END)"


@register("g7_check_quota", f"""SELECT u.id, u.username, {quota_status_sql('u', 'd')} AS quota_status
  FROM {USERS_SQL} u LEFT JOIN {TODAY_SQL} d ON d.user_id = u.id""")
def g7_check_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return US.check_quota(derived.users(spark, sf_dir), _today(spark, sf_dir))


def _report_sql() -> str:
    rows = []
    for i, (label, uc, qc, kind) in enumerate(US.REPORT_ROWS):
        used = f"coalesce(d.{uc}, 0)"
        used_txt = fmt_tokens_sql(used) if kind == "tokens" else fmt_bytes_sql(used) if kind == "bytes" else f"CAST({used} AS VARCHAR)"
        pv = f"(CASE WHEN u.{qc} IS NULL THEN 0.0 WHEN u.{qc} = 0 THEN 100.0 ELSE {used} / u.{qc} * 100.0 END)"
        filled = f"CAST(floor(least(greatest({pv}, 0.0), 100.0) / 12.5) AS INTEGER)"
        rows.append(f"""SELECT u.id, u.username, {i} AS pos, '{label}' AS metric, coalesce(CAST(u.{qc} AS VARCHAR), '∞') AS limit_text,
          {used_txt} AS used_text,
          CASE WHEN u.{qc} IS NULL THEN '—' WHEN u.{qc} = 0 THEN '100' ELSE printf('%.0f', {used} / u.{qc} * 100.0) || '%' END AS pct,
          repeat('█', {filled}) || repeat('░', 8 - {filled}) AS bar
          FROM {USERS_SQL} u LEFT JOIN {TODAY_SQL} d ON d.user_id = u.id""")
    return " UNION ALL ".join(rows)


@register("g9_quota_report", _report_sql())
def g9_quota_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return US.quota_report(derived.users(spark, sf_dir), _today(spark, sf_dir))


@register("g11_login_counters", f"""SELECT username, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS n_ok,
  CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS n_fail, max(CASE WHEN ok THEN ts END) AS last_ok
  FROM {derived.login_attempts_sql()} GROUP BY username""")
def g11_login_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return US.login_counters(derived.login_attempts(spark, sf_dir))


@register("g13_billing_monthly", f"""SELECT user_id, date_trunc('month', ts) AS month, count(*) AS requests,
  CAST(sum(tok_in) AS BIGINT) AS tok_in, CAST(sum(tok_out) AS BIGINT) AS tok_out, CAST(sum(bytes_in) AS BIGINT) AS bytes_in,
  CAST(sum(bytes_out) AS BIGINT) AS bytes_out, CAST(count(*) FILTER (WHERE status >= 400) AS BIGINT) AS failed
  FROM {LOG_SQL} GROUP BY ALL""")
def g13_billing_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return US.billing_ledger_monthly(derived.request_log(spark, sf_dir))


@register("a3_read_users", f"SELECT * FROM {USERS_SQL} ORDER BY username")
def a3_read_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return US.read_users(derived.users(spark, sf_dir))


@register("a6_write_usage", f"""SELECT user_id, day, CAST(sum(req) AS BIGINT) AS req, CAST(sum(tok_in) AS BIGINT) AS tok_in,
  CAST(sum(tok_out) AS BIGINT) AS tok_out, CAST(sum(bytes_in) AS BIGINT) AS bytes_in, CAST(sum(bytes_out) AS BIGINT) AS bytes_out
  FROM (SELECT * FROM {USAGE_SQL} UNION ALL SELECT user_id, day + 1 AS day, req, tok_in, tok_out, bytes_in, bytes_out FROM {USAGE_SQL})
  GROUP BY user_id, day""")
def a6_write_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _usage(spark, sf_dir)
    return US.write_usage(u, u.withColumn("day", F.date_add("day", 1)))


@register("a7_delete_user", f"""SELECT * FROM {USAGE_SQL} WHERE user_id NOT IN (SELECT id FROM {USERS_SQL} WHERE status = 'disabled')""")
def a7_delete_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = derived.users(spark, sf_dir)
    _, usage = US.delete_users(users, _usage(spark, sf_dir), users.where(F.col("status") == "disabled"))
    return usage


@register("a7_delete_user_rows", f"SELECT id, username, status FROM {USERS_SQL} WHERE status <> 'disabled'")
def a7_delete_user_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = derived.users(spark, sf_dir)
    left, _ = US.delete_users(users, _usage(spark, sf_dir), users.where(F.col("status") == "disabled"))
    return left.select("id", "username", "status")


@register("a8_update_users", f"""SELECT id, username, CASE WHEN status = 'disabled' THEN 'active' ELSE status END AS status,
  CASE WHEN status = 'disabled' THEN 'admin' ELSE role END AS role,
  CASE WHEN status = 'disabled' THEN CAST(10 AS BIGINT) ELSE quota_req_day END AS quota_req_day,
  CASE WHEN status = 'disabled' THEN CAST(NULL AS BIGINT) ELSE quota_tok_in END AS quota_tok_in,
  CASE WHEN status = 'disabled' THEN CAST(NULL AS BIGINT) ELSE quota_tok_out END AS quota_tok_out,
  CASE WHEN status = 'disabled' THEN CAST(5000 AS BIGINT) ELSE quota_bytes_in END AS quota_bytes_in,
  CASE WHEN status = 'disabled' THEN CAST(NULL AS BIGINT) ELSE quota_bytes_out END AS quota_bytes_out FROM {USERS_SQL}""")
def a8_update_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = derived.users(spark, sf_dir)
    changes = users.where(F.col("status") == "disabled").select(
        "id", F.lit("active").alias("status"), F.lit("admin").alias("role"), F.lit(True).alias("set_quota"),
        F.lit(10).cast("long").alias("quota_req_day"), F.lit(5000).cast("long").alias("quota_bytes_in"))
    return US.update_users(users, changes)


# --- H: metrics, I: access ----------------------------------------------------------------------
TARGETS_SQL = "(SELECT host, coalesce(port, 443) AS port, coalesce(tls, TRUE) AS tls FROM (VALUES " + ", ".join(
    f"('{h}', {p if p is not None else 'NULL'}, {('TRUE' if t else 'FALSE') if t is not None else 'NULL'})"
    for h, p, t in AC.TARGETS) + ") AS t(host, port, tls))"
RESOLVED_SQL = f"""(SELECT l.*, split_part(l.host, ':', 1) AS target, coalesce(t.port, 443) AS target_port,
  coalesce(t.tls, TRUE) AS target_tls, t.host IS NOT NULL AS inspected
  FROM {LOG_SQL} l LEFT JOIN {TARGETS_SQL} t ON t.host = split_part(l.host, ':', 1))"""


def resolved_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AC.resolve_target(derived.request_log(spark, sf_dir), AC.load_targets(spark))


register("i1_resolve_target", f"SELECT req_id, target, target_port, target_tls, inspected FROM {RESOLVED_SQL}")(
    lambda spark, sf_dir: resolved_log(spark, sf_dir).select("req_id", "target", "target_port", "target_tls", "inspected"))
register("i2_drop_loopback", f"""SELECT req_id, host FROM {LOG_SQL}
  WHERE lower(split_part(host, ':', 1)) NOT IN ({', '.join(O.q(h) for h in AC.LOOPBACK)})""")(
    lambda spark, sf_dir: AC.drop_loopback(derived.request_log(spark, sf_dir)).select("req_id", "host"))

register("h1_requests_by", f"SELECT method, target, inspected, count(*) AS requests FROM {RESOLVED_SQL} GROUP BY ALL")(
    lambda spark, sf_dir: ME.requests_by(resolved_log(spark, sf_dir)))
register("h2_bytes_by_direction", f"""SELECT 'request' AS direction, CAST(sum(bytes_in) AS BIGINT) AS bytes FROM {LOG_SQL}
  UNION ALL SELECT 'response', CAST(sum(bytes_out) AS BIGINT) FROM {LOG_SQL}""")(
    lambda spark, sf_dir: ME.bytes_by_direction(derived.request_log(spark, sf_dir)))
register("h3_latency_histogram", "SELECT target, " + ", ".join(
    f"CAST(count(*) FILTER (WHERE duration_s <= {b}) AS BIGINT) AS le_{f'{b:g}'.replace('.', '_')}" for b in ME.LATENCY_BOUNDS)
    + f", count(*) AS le_inf, sum(duration_s) AS sum_s FROM {RESOLVED_SQL} GROUP BY target")(
    lambda spark, sf_dir: ME.latency_histogram(resolved_log(spark, sf_dir)))
register("h4_violations_by", f"SELECT lower(violation_type) AS type, resource AS target, count(*) AS violations FROM {EVENTS_SQL} GROUP BY ALL")(
    lambda spark, sf_dir: ME.violations_by(violation_events(spark, sf_dir)))
register("h6_active_connections", f"""SELECT t AS ts, CAST(sum(d) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS active FROM (
  SELECT t, sum(d) AS d FROM (SELECT ts AS t, 1 AS d FROM {LOG_SQL}
    UNION ALL SELECT ts + to_microseconds(CAST(round(duration_s * 1000000) AS BIGINT)) AS t, -1 AS d FROM {LOG_SQL}) GROUP BY t)""")(
    lambda spark, sf_dir: ME.active_connections(derived.request_log(spark, sf_dir)))
register("h7_active_users", f"SELECT target, count(DISTINCT user_id) AS active_users FROM {RESOLVED_SQL} GROUP BY target")(
    lambda spark, sf_dir: ME.active_users(resolved_log(spark, sf_dir)))
register("h8_errors_by_target", f"SELECT target, count(*) AS errors FROM {RESOLVED_SQL} WHERE status >= 500 GROUP BY target")(
    lambda spark, sf_dir: ME.errors_by_target(resolved_log(spark, sf_dir)))

MSG_RESOLVED_SQL = f"""(SELECT m.msg_id, t.host IS NOT NULL AS inspected, t.host IS NOT NULL AND strlen(m.body) > {AC.MAX_BODY_BYTES} AS rejected,
  contains(m.body, '{AC.STREAM_MARKER}') AS streaming FROM {MSG_SQL} m LEFT JOIN {TARGETS_SQL} t ON t.host = split_part(m.host, ':', 1))"""


@register("i3_split_inspected", f"SELECT msg_id, inspected, rejected, streaming, inspected AND NOT rejected AS scan FROM {MSG_RESOLVED_SQL}")
def i3_split_inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = AC.resolve_target(derived.messages(spark, sf_dir), AC.load_targets(spark))
    return AC.split_inspected(m).select("msg_id", "inspected", "rejected", "streaming", "scan")


def _key_match_sql(pattern: str, path: str) -> str:
    prefix = f"regexp_extract({pattern}, '^(.*)/\\*$', 1)"
    return (f"({pattern} = '*' OR (ends_with({pattern}, '/*') AND ({path} = {prefix} OR starts_with({path}, {prefix} || '/'))) "
            f"OR (NOT ends_with({pattern}, '/*') AND {pattern} = {path}))")


POLICIES_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{p}', '{m}')" for r, p, m in AC.POLICIES) + ") AS p(p_role, pattern, p_method))"


@register("i4_enforce_policies", f"""SELECT l.req_id, coalesce(u.role, 'user') AS role,
  EXISTS (SELECT 1 FROM {POLICIES_SQL} p WHERE p.p_role = coalesce(u.role, 'user') AND {_key_match_sql('p.pattern', 'l.path')}
          AND (p.p_method = '*' OR p.p_method = l.method)) AS allowed
  FROM {LOG_SQL} l LEFT JOIN {USERS_SQL} u ON u.id = l.user_id""")
def i4_enforce_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = AC.enforce_policies(derived.request_log(spark, sf_dir), derived.users(spark, sf_dir), AC.load_policies(spark))
    return r.select("req_id", "role", "allowed")


@register("i5_drop_revoked", f"""SELECT req_id, user_id FROM {LOG_SQL} WHERE user_id NOT IN (
  SELECT id FROM {USERS_SQL} WHERE CAST(substring(id, 2) AS BIGINT) % 10 = 3)""")
def i5_drop_revoked(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = derived.users(spark, sf_dir)
    revoked = users.where(F.substring("id", 2, 100).cast("long") % 10 == 3)
    return AC.drop_revoked(derived.request_log(spark, sf_dir), revoked).select("req_id", "user_id")


@register("i6_only_active", f"SELECT req_id, user_id FROM {LOG_SQL} WHERE user_id IN (SELECT id FROM {USERS_SQL} WHERE status = 'active')")
def i6_only_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AC.only_active(derived.request_log(spark, sf_dir), derived.users(spark, sf_dir)).select("req_id", "user_id")


def _route_sql() -> str:
    h = "split_part(l.host, ':', 1)"
    direct = (f"(strpos({h}, '.') = 0 OR regexp_matches({h}, '^localhost$') OR regexp_matches({h}, '^127\\..*$') "
              f"OR regexp_matches({h}, '^10\\..*$') OR regexp_matches({h}, '^192\\.168\\..*$') "
              f"OR (regexp_matches({h}, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') AND split_part({h}, '.', 1) = '172' "
              f"AND TRY_CAST(split_part({h}, '.', 2) AS INTEGER) BETWEEN 16 AND 31))")
    proxied = f"EXISTS (SELECT 1 FROM {TARGETS_SQL} t WHERE ends_with({h}, '.' || t.host))"
    return f"SELECT l.req_id, CASE WHEN {direct} OR NOT {proxied} THEN 'DIRECT' ELSE 'PROXY' END AS route FROM {LOG_SQL} l"


@register("i9_route_class", _route_sql())
def i9_route_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AC.route_class(derived.request_log(spark, sf_dir), AC.load_targets(spark)).select("req_id", "route")


# --- flagship: protected documents summary ------------------------------------------------------
def protected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> scan -> tokenize (session = doc user and host); one row per document."""
    docs = derived.messages(spark, sf_dir, with_fixtures=False, extra=[F.col("lang")])
    return R.tokenize(docs, "body", "user_id", "host")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections per language and type: documents, spans and distinct tokens."""
    t = protected_documents(spark, sf_dir)
    ex = explode_spans(t, "detections", ["msg_id", "lang"]).select("msg_id", "lang", "_e.type", "_e.core")
    return ex.groupBy("lang", "type").agg(F.count_distinct("msg_id").alias("documents"),
                                          F.count(F.lit(1)).alias("detections"),
                                          F.count_distinct("core").alias("distinct_tokens"))


_DOC_MSG_SQL = derived.messages_sql(with_fixtures=False)
register("protect_summary", f"""SELECT d.lang, t.type, count(DISTINCT t.msg_id) AS documents, count(*) AS detections,
  count(DISTINCT t.core) AS distinct_tokens FROM {O.tokens_sql(_DOC_MSG_SQL)} t JOIN documents d ON d.doc_id = t.msg_id
  GROUP BY d.lang, t.type""")(flagship)


# --- B14, E: verdicts --------------------------------------------------------------------------
from spanshield.operators import verdict as VE  # noqa: E402

DETS_SQL = f"(SELECT id AS msg_id, ord, start, \"end\", type, text, masked FROM {SCAN_SQL})"


def context_sql(body: str, needle: str, radius: int = VE.CONTEXT_RADIUS_BYTES) -> str:
    pos = f"strpos({body}, {needle})"
    pre = f"substring({body}, 1, {pos} - 1)"
    post = f"substring({body}, {pos} + length({needle}))"
    k_pre = f"list_max(list_filter(range(0, {radius + 1}), lambda k: strlen(right({pre}, k)) <= {radius}))"
    k_post = f"list_max(list_filter(range(0, {radius + 1}), lambda k: strlen(left({post}, k)) <= {radius}))"
    snippet = f"(right({pre}, {k_pre}) || {needle} || left({post}, {k_post}))"
    return f"(CASE WHEN {pos} > 0 THEN replace({snippet}, {needle}, '{VE.DETECTED}') ELSE '{VE.NO_CONTEXT}' END)"


@register("b14_context_window", f"""SELECT d.msg_id, d.ord, {context_sql('m.body', 'd.text')} AS context
  FROM {DETS_SQL} d JOIN {MSG_SQL} m ON m.msg_id = d.msg_id""")
def b14_context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = D.detect(derived.messages(spark, sf_dir), "body")
    near = m.select("msg_id", VE.contexts(F.col("body"), F.col("detections")).alias("_d"))
    return explode_spans(near, "_d", ["msg_id"], pos="ord").select("msg_id", "ord", F.col("_e.context").alias("context"))


def _label_sql(t: str) -> str:
    return "(CASE " + " ".join(f"WHEN {t} = '{k}' THEN '{v}'" for k, v in VE.LABELS.items()) + " ELSE 'OTHER' END)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def items_sql(dets: str) -> str:
    return f"""(SELECT *, CAST((n - 1) // {VE.MAX_ITEMS} AS INTEGER) AS part, CAST((n - 1) % {VE.MAX_ITEMS} + 1 AS INTEGER) AS item
      FROM (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY ord) AS n FROM {dets} WHERE type <> 'SECRET'))"""


def requests_sql(dets: str, bodies: str) -> str:
    return f"""(SELECT msg_id, part, n_items, prompt, sha256(prompt) AS prompt_hash FROM (
      SELECT msg_id, part, CAST(max(item) AS BIGINT) AS n_items, {_q(VE.PROMPT_HEADER)} || string_agg(line, '' ORDER BY item) || {_q(VE.PROMPT_FOOTER)} AS prompt
      FROM (SELECT d.msg_id, d.part, d.item, CAST(d.item AS VARCHAR) || '. [' || {_label_sql('d.type')} || '] "' || d.text || '" — context: '
                   || {context_sql('m.body', 'd.text')} || chr(10) AS line
            FROM {items_sql(dets)} d JOIN {bodies} m ON m.msg_id = d.msg_id)
      GROUP BY msg_id, part))"""


REQUESTS_SQL = requests_sql(DETS_SQL, MSG_SQL)


def verdict_requests(messages: DataFrame) -> DataFrame:
    """The requests as a written table: the judge outside reads it, and its answers come back by hash."""
    path = f"{ensure_checkpoint_dir(messages.sparkSession)}/requests-{uuid.uuid4().hex}"
    r = VE.build_verdict_requests(messages)
    r.write.parquet(path)
    return messages.sparkSession.read.schema(r.schema).parquet(path)


@register("e2_verdict_requests", f"SELECT msg_id, part, n_items, prompt, prompt_hash FROM {REQUESTS_SQL}")
def e2_verdict_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = D.detect(derived.messages(spark, sf_dir), "body")
    return VE.build_verdict_requests(m).drop("ords")


def judge_responses(requests: DataFrame) -> DataFrame:
    """Stand-in judge answers derived from each request (formats vary with the hash's first digit:
    comma, comma-space, newline, prose; some answers one item short or one too many)."""
    c = F.substring("prompt_hash", 1, 1)
    k = F.when(c.isin("2", "3"), F.col("n_items") + 1).when(c.isin("6", "7"), F.col("n_items") - 1).otherwise(F.col("n_items"))
    items = F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.when(i % 2 == 1, F.lit("1")).otherwise(F.lit("0")))
    items = F.slice(items, 1, F.greatest(k, F.lit(0)))
    raw = (F.when(c.isin("0", "1", "2", "3"), F.array_join(items, ","))
           .when(c.isin("4", "5", "6", "7"), F.array_join(items, ", "))
           .when(c.isin("8", "9", "a", "b"), F.array_join(items, "\n"))
           .otherwise(F.concat(F.lit("Sure, here you go: "), F.array_join(items, ","))))
    return VE.distinct_requests(requests).select("prompt_hash", raw.alias("raw"))


def responses_sql(requests: str) -> str:
    return f"""(SELECT prompt_hash, CASE
    WHEN c IN ('0','1','2','3') THEN array_to_string(items, ',') WHEN c IN ('4','5','6','7') THEN array_to_string(items, ', ')
    WHEN c IN ('8','9','a','b') THEN array_to_string(items, chr(10)) ELSE 'Sure, here you go: ' || array_to_string(items, ',') END AS raw
  FROM (SELECT prompt_hash, c, list_transform(range(1, k + 1), lambda i: CASE WHEN i % 2 = 1 THEN '1' ELSE '0' END) AS items
        FROM (SELECT DISTINCT prompt_hash, left(prompt_hash, 1) AS c,
                CASE WHEN left(prompt_hash, 1) IN ('2','3') THEN n_items + 1 WHEN left(prompt_hash, 1) IN ('6','7') THEN n_items - 1
                     ELSE n_items END AS k FROM {requests})))"""


def verdicts_sql(requests: str) -> str:
    return f"""(SELECT prompt_hash, CAST(pos AS INTEGER) AS item, trim(t) = '1' AS keep FROM (
  SELECT prompt_hash, unnest(parts) AS t, unnest(range(1, len(parts) + 1)) AS pos FROM (
    SELECT prompt_hash, list_filter(string_split_regex(regexp_replace(raw, '[^0-9,\\n ]', '', 'g'), '[,\\n ]'),
                                    lambda t: trim(t) IN ('0', '1')) AS parts
    FROM {responses_sql(requests)} WHERE left(ltrim(raw), 1) IN ('0', '1', '[', '{{'))))"""


VERDICTS_SQL = verdicts_sql(REQUESTS_SQL)


@register("e3_parse_verdicts", f"SELECT * FROM {VERDICTS_SQL}")
def e3_parse_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = verdict_requests(D.detect(derived.messages(spark, sf_dir), "body"))
    return VE.parse_verdicts(judge_responses(req))


def keep_sql(dets: str, requests: str) -> str:
    return f"""(SELECT d.*, (d.type = 'SECRET' OR r.prompt_hash IS NULL OR coalesce(v.keep, TRUE)) AS keep
      FROM {dets} d
      LEFT JOIN {items_sql(dets)} p ON p.msg_id = d.msg_id AND p.ord = d.ord
      LEFT JOIN {requests} r ON r.msg_id = d.msg_id AND r.part = p.part
      LEFT JOIN {verdicts_sql(requests)} v ON v.prompt_hash = r.prompt_hash AND v.item = p.item)"""


KEEP_SQL = keep_sql(DETS_SQL, REQUESTS_SQL)


def rejected_by_judge(messages: DataFrame) -> DataFrame:
    req = verdict_requests(messages)
    return VE.rejected(req, VE.parse_verdicts(judge_responses(req)))


@register("e1_apply_verdicts", f"SELECT msg_id, ord, type, text, keep FROM {KEEP_SQL}")
def e1_apply_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = D.detect(derived.messages(spark, sf_dir), "body")
    req = verdict_requests(m)
    dets = D.explode_detections(m, keep=["msg_id"]).select("msg_id", "ord", "type", "text")
    return VE.apply_verdicts(dets, req, VE.parse_verdicts(judge_responses(req)))


@register("c7_restore_rejected", f"""SELECT r.id AS msg_id, r.restored_body FROM {O.rebuild_sql(MSG_SRC,
    f'(SELECT k.msg_id AS id, k.start, k."end", {chr(39)}[{chr(39)} || t.core || {chr(39)}]{chr(39)} AS repl FROM {KEEP_SQL} k JOIN {TOKENS_SQL} t ON t.msg_id = k.msg_id AND t.ord = k.ord WHERE k.keep)',
    'restored_body')} r""")
def c7_restore_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokenized_messages(spark, sf_dir)
    return R.restore_rejected(t, "body", rejected_by_judge(t), out="restored_body").select("msg_id", "restored_body")


@register("e4_embedding_flag", """WITH ex AS (SELECT label, i, CAST(embedding[i] AS DOUBLE) AS x
    FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
  c AS (SELECT label, list(x ORDER BY i) AS centroid FROM (SELECT label, i, avg(x) AS x FROM ex GROUP BY label, i) GROUP BY label),
  s AS (SELECT e.vec_id, max(list_cosine_similarity(list_transform(e.embedding, lambda v: CAST(v AS DOUBLE)), c.centroid)) AS max_cos
        FROM embeddings e, c GROUP BY e.vec_id)
  SELECT vec_id, round(max_cos, 4) AS max_cos, max_cos >= 0.65 AS flagged FROM s""")
def e4_embedding_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanshield.sources.tables import read_table
    emb = read_table(spark, sf_dir, "embeddings")
    f = VE.embedding_flags(emb, VE.label_centroids(emb))
    return f.select("vec_id", F.round("max_cos", 4).alias("max_cos"), "flagged")


# --- G1, G2, G12: usage from provider bodies ------------------------------------------------------
import re as _re  # noqa: E402

# provider reply bodies derived from each request (template chosen by req_id % 8)
REPLY_TEMPLATES = [
    '{"model":"gpt-4o","usage":{"prompt_tokens":{tin},"completion_tokens":{tout},"total_tokens":{tsum}}}',
    '{"model":"claude-3-5","usage":{"input_tokens":{tin},"output_tokens":{tout}}}',
    '{"model":"gpt-4o","choices":[]}',
    '{"model":"gpt-4o","usage":{}}',
    '{"usage":{"prompt_tokens":0,"completion_tokens":0}}',
    '{"usage":{"prompt_tokens":{tin}}}',
    'upstream error {rid}',
    '{"model":5,"usage":{"prompt_tokens":-3,"completion_tokens":2.5,"input_tokens":{tin}}}',
]
SSE_TEMPLATES = [
    'data: {"choices":[{"delta":{"content":"Hel"}}]}\n\ndata: {"choices":[{"delta":{"content":"lo"}}]}\n\n'
    'data: {"choices":[],"usage":{"prompt_tokens":{tin},"completion_tokens":{tout}}}\n\ndata: [DONE]\n\n',
    'event: message_start\ndata: {"type":"message_start","message":{"usage":{"input_tokens":{tin},"output_tokens":1}}}\n\n'
    'event: content_block_delta\ndata: {"type":"content_block_delta","delta":{"text":"Hi"}}\n\n'
    'event: message_delta\ndata: {"type":"message_delta","usage":{"output_tokens":{tout}}}\n\n',
    'data: {"choices":[{"delta":{"content":"Hi"}}]}\n\ndata: [DONE]\n\n',
]
_PH = {"tin": "tok_in", "tout": "tok_out", "tsum": "tok_in + tok_out", "rid": "req_id"}


def _template_spark(t: str):
    parts = []
    for piece in _re.split(r"(\{tin\}|\{tout\}|\{tsum\}|\{rid\})", t):
        if piece in ("{tin}", "{tout}", "{tsum}", "{rid}"):
            parts.append(F.expr(_PH[piece[1:-1]]).cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def _template_sql(t: str) -> str:
    parts = []
    for piece in _re.split(r"(\{tin\}|\{tout\}|\{tsum\}|\{rid\})", t):
        if piece in ("{tin}", "{tout}", "{tsum}", "{rid}"):
            parts.append(f"CAST({_PH[piece[1:-1]]} AS VARCHAR)")
        elif piece:
            parts.append(_q(piece).replace("\n", "' || chr(10) || '"))
    return "(" + " || ".join(parts) + ")"


def _pick_spark(templates, key):
    expr = None
    for i, t in enumerate(templates):
        expr = F.when(key == i, _template_spark(t)) if expr is None else expr.when(key == i, _template_spark(t))
    return expr


def _pick_sql(templates, key: str) -> str:
    return "(CASE " + " ".join(f"WHEN {key} = {i} THEN {_template_sql(t)}" for i, t in enumerate(templates)) + " END)"


def provider_replies(spark, sf_dir):
    log = derived.request_log(spark, sf_dir)
    return log.select(F.col("req_id").alias("resp_id"), _pick_spark(REPLY_TEMPLATES, F.col("req_id") % 8).alias("body"))


REPLIES_BODY_SQL = f"(SELECT req_id AS resp_id, {_pick_sql(REPLY_TEMPLATES, 'req_id % 8')} AS body FROM {LOG_SQL})"


def _u64_sql(path: str) -> str:
    return f"(CASE WHEN json_type(body, '{path}') = 'UBIGINT' THEN CAST(json_extract(body, '{path}') AS BIGINT) END)"


@register("g1_parse_usage", f"""SELECT resp_id, CASE WHEN p1 IS NOT NULL OR c1 IS NOT NULL THEN p1 ELSE p2 END AS prompt,
  CASE WHEN p1 IS NOT NULL OR c1 IS NOT NULL THEN c1 ELSE c2 END AS completion, model FROM (
  SELECT resp_id, {_u64_sql('$.usage.prompt_tokens')} AS p1, {_u64_sql('$.usage.completion_tokens')} AS c1,
         {_u64_sql('$.usage.input_tokens')} AS p2, {_u64_sql('$.usage.output_tokens')} AS c2,
         CASE WHEN json_type(body, '$.model') = 'VARCHAR' THEN json_extract_string(body, '$.model') END AS model
  FROM {REPLIES_BODY_SQL} WHERE json_valid(body) AND json_type(body) = 'OBJECT' AND json_type(body, '$.usage') = 'OBJECT')
  WHERE p1 IS NOT NULL OR c1 IS NOT NULL OR p2 IS NOT NULL OR c2 IS NOT NULL""")
def g1_parse_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = US.parse_usage(provider_replies(spark, sf_dir))
    return p.where(F.col("usage").isNotNull()).select("resp_id", "usage.prompt", "usage.completion", "usage.model")


def _json_str(c):
    j = F.to_json(F.array(c))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def chat_bodies(spark, sf_dir):
    """One chat request body per conversation: even turns as string content, odd turns as parts."""
    from spanshield.sources.tables import read_table
    conv = read_table(spark, sf_dir, "conversations")
    content = F.when(F.col("turn") % 2 == 0, _json_str(F.col("text"))).otherwise(F.concat(
        F.lit('[{"type":"text","text":'), _json_str(F.col("text")),
        F.lit('},{"type":"image_url","image_url":{"url":"data:image/png;base64,AAAA"}}]')))
    msg = F.concat(F.lit('{"role":'), _json_str(F.col("role")), F.lit(',"content":'), content, F.lit("}"))
    g = conv.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", msg.alias("m")))).alias("ms"))
    return g.select("conv_id", F.concat(F.lit('{"model":"m","messages":['),
                                        F.array_join(F.transform("ms", lambda x: x["m"]), ","), F.lit("]}")).alias("body"))


@register("g2_estimate_tokens", """SELECT conv_id, CASE WHEN coalesce(sum(strlen(text)), 0) > 0
  THEN CAST(ceil(sum(strlen(text)) / 4.0) AS BIGINT) END AS est_tokens FROM conversations GROUP BY conv_id""")
def g2_estimate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_bodies(spark, sf_dir).select("conv_id", US.estimate_tokens(F.col("body")).alias("est_tokens"))


def _sse_key(host_col, rid):
    return F.when(F.col(host_col).contains("anthropic"), F.lit(1)).when(rid % 3 == 2, F.lit(2)).otherwise(F.lit(0))


@register("g12_usage_from_stream", f"""SELECT req_id, CASE WHEN k = 2 THEN NULL ELSE tok_in END AS prompt,
  CASE WHEN k = 2 THEN NULL ELSE tok_out END AS completion FROM (
  SELECT req_id, tok_in, tok_out, CASE WHEN contains(host, 'anthropic') THEN 1 WHEN req_id % 3 = 2 THEN 2 ELSE 0 END AS k FROM {LOG_SQL})""")
def g12_usage_from_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = derived.request_log(spark, sf_dir)
    sse = log.select("req_id", _pick_spark(SSE_TEMPLATES, _sse_key("host", F.col("req_id"))).alias("sse"))
    return sse.select("req_id", US.usage_from_stream(F.col("sse")).alias("u")).select("req_id", "u.prompt", "u.completion")


# --- B11-B13, C6 (payloads), H5: attachments ------------------------------------------------------
from spanshield.operators import attachments as AT  # noqa: E402


def attachment_messages(spark, sf_dir):
    """Each document as a JSON body carrying it as a text attachment, plus attachments of every kind."""
    docs = derived.messages(spark, sf_dir, with_fixtures=False)
    body = F.concat(F.lit('{"text":"see attached","file":"data:text/plain;base64,'), AT.b64encode(F.encode("body", "UTF-8")),
                    F.lit('"}'))
    d = docs.select("msg_id", "user_id", "host", body.alias("body"))
    return d.unionByName(fixture_df(spark, "attachments"))


ATT_MSG_SQL = f"""(SELECT msg_id, user_id, host, '{{"text":"see attached","file":"data:text/plain;base64,' || to_base64(encode(body)) || '"}}' AS body
  FROM {derived.messages_sql(with_fixtures=False)} UNION ALL SELECT * FROM {fixture_sql('attachments')})"""

_NONPRINT = "len(list_filter(regexp_extract_all(hex(bytes), '..'), lambda h: h < '09' OR h = '0B' OR (h >= '0E' AND h < '20') OR h = '7F'))"
_FORMAT_SQL = f"""CASE WHEN octet_length(bytes) = 0 THEN 'binary'
    WHEN starts_with(hex(bytes), '25504446') OR starts_with(hex(bytes), '504B0304') THEN 'application'
    WHEN starts_with(hex(bytes), 'FFD8') OR starts_with(hex(bytes), '89504E47') OR starts_with(hex(bytes), '47494638') THEN 'image'
    WHEN starts_with(hex(bytes), '52494646') AND substring(hex(bytes), 17, 8) = '57454250' THEN 'image'
    WHEN starts_with(hex(bytes), '424D') THEN 'image'
    WHEN try(decode(bytes)) IS NOT NULL AND (octet_length(bytes) - {_NONPRINT}) / octet_length(bytes) > {AT.TEXT_PRINTABLE_RATIO} THEN 'text'
    ELSE 'binary' END"""
ATT_SQL = f"""(SELECT msg_id, user_id, host, CAST(idx AS INTEGER) AS idx, uri, mime, bytes, {_FORMAT_SQL} AS format,
    coalesce(try(decode(bytes)), CAST(bytes AS VARCHAR)) AS text FROM (
  SELECT msg_id, user_id, host, row_number() OVER (PARTITION BY msg_id ORDER BY pos) AS idx, uri,
         regexp_extract(uri, {_q(AT.DATA_URI_RE)}, 1) AS mime, from_base64(regexp_extract(uri, {_q(AT.DATA_URI_RE)}, 2)) AS bytes
  FROM (SELECT msg_id, user_id, host, unnest(u) AS uri, unnest(range(1, len(u) + 1)) AS pos
        FROM (SELECT msg_id, user_id, host, regexp_extract_all(body, {_q(AT.DATA_URI_RE)}) AS u FROM {ATT_MSG_SQL}))
  WHERE regexp_matches(regexp_extract(uri, {_q(AT.DATA_URI_RE)}, 2), {_q(AT.BASE64_RE)})))"""


def _attachments(spark, sf_dir):
    return AT.extract_attachments(attachment_messages(spark, sf_dir), keep=("msg_id", "user_id", "host"))


@register("b11_extract_attachments", f"SELECT msg_id, idx, mime, octet_length(bytes) AS n_bytes, format FROM {ATT_SQL}")
def b11_extract_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attachments(spark, sf_dir).select("msg_id", "idx", "mime", F.octet_length("bytes").alias("n_bytes"), "format")


_ATT_AS_MSG = f"(SELECT msg_id * 100 + idx AS msg_id, user_id, host, '/attachment' AS path, TIMESTAMP '2024-01-01' AS ts, text AS body FROM {ATT_SQL})"
_ATT_TOKENS = O.tokens_sql(_ATT_AS_MSG)
SCANNED_SQL = f"""(SELECT a.msg_id, a.idx, a.format, a.mime, a.uri, coalesce(n.n, 0) AS n_detections,
    CASE WHEN coalesce(n.n, 0) = 0 THEN 'pass' WHEN a.format = 'text' THEN 'masked' ELSE 'blocked' END AS outcome
  FROM {ATT_SQL} a LEFT JOIN (SELECT msg_id AS id, count(*) AS n FROM {_ATT_TOKENS} GROUP BY msg_id) n ON n.id = a.msg_id * 100 + a.idx)"""


def _scanned(spark, sf_dir):
    return AT.scan_attachments(_attachments(spark, sf_dir))


@register("b13_scan_attachments", f"SELECT msg_id, idx, format, outcome, CAST(n_detections AS INTEGER) AS n_detections FROM {SCANNED_SQL}")
def b13_scan_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir).select("msg_id", "idx", "format", "outcome", F.size("detections").alias("n_detections"))


@register("f1_attachment_events", f"""SELECT CAST(floor(t.msg_id / 100.0) AS BIGINT) AS msg_id,
    t.ord, m.user_id, m.host AS resource, t.type AS violation_type, t.masked AS masked_context, 'MASK' AS token, 'attachment' AS request_path
  FROM {_ATT_TOKENS} t JOIN {_ATT_AS_MSG} m ON m.msg_id = t.msg_id""")
def f1_attachment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections inside attachments as audit events: never the value, only its masked form."""
    found = explode_spans(_scanned(spark, sf_dir), "detections", ["msg_id", "user_id", "host"], pos="ord").select(
        "msg_id", "ord", "user_id", "host", F.lit(None).cast("timestamp").alias("ts"), "_e.type", "_e.masked")
    return AU.attachment_events(found, keep=("msg_id", "ord")).drop("ts")


@register("h5_file_scans_by", f"SELECT format, outcome, count(*) AS scans FROM {SCANNED_SQL} GROUP BY ALL")
def h5_file_scans_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ME.file_scans_by(_scanned(spark, sf_dir))


_ATT_TOKENIZED = O.rebuild_sql(f"(SELECT msg_id AS id, body AS text FROM {_ATT_AS_MSG})",
                               f"(SELECT msg_id AS id, start, \"end\", '[' || core || ']' AS repl FROM {_ATT_TOKENS})", "tok")


@register("c6_rewrite_attachments", f"""SELECT m.msg_id, CASE WHEN r.reps IS NULL THEN m.body
    ELSE list_reduce(r.reps, lambda acc, x: replace(acc, x.uri, x.rep), m.body) END AS body_out
  FROM {ATT_MSG_SQL} m LEFT JOIN (
    SELECT s.msg_id, list({{'uri': s.uri, 'rep': '"data:' || s.mime || ';base64,' ||
        CASE WHEN s.format = 'text' THEN to_base64(encode(t.tok)) ELSE to_base64(encode('{AT.BLOCKED_TEXT}')) END || '"'}} ORDER BY s.idx) AS reps
    FROM {SCANNED_SQL} s LEFT JOIN {_ATT_TOKENIZED} t ON t.id = s.msg_id * 100 + s.idx
    WHERE s.outcome <> 'pass' GROUP BY s.msg_id) r ON r.msg_id = m.msg_id""")
def c6_rewrite_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AT.rewrite_attachments(attachment_messages(spark, sf_dir), _scanned(spark, sf_dir)).select("msg_id", "body_out")


# --- G8, I7, I8: ordered folds --------------------------------------------------------------------
from spanshield.operators import folds as FO  # noqa: E402


def _adm_ok(prefix: str) -> str:
    cs = [f"{prefix}c{i}" for i in range(1, 6)] if prefix else ["0"] * 5
    deltas = ["1", "d.tok_in", "d.tok_out", "d.bytes_in", "d.bytes_out"]
    conds = [f"(d.q{i + 1} IS NULL OR {c} + {dv} <= d.q{i + 1})" for i, (c, dv) in enumerate(zip(cs, deltas))]
    return "(" + " AND ".join(conds) + ")"


def _adm_cols(prefix: str) -> str:
    cs = [f"{prefix}c{i}" for i in range(1, 6)] if prefix else ["0"] * 5
    deltas = ["1", "d.tok_in", "d.tok_out", "d.bytes_in", "d.bytes_out"]
    ok = _adm_ok(prefix)
    return ", ".join(f"CASE WHEN {ok} THEN {c} + {dv} ELSE {c} END AS c{i + 1}" for i, (c, dv) in enumerate(zip(cs, deltas)))


@register("g8_quota_admission", f"""WITH RECURSIVE d AS (
    SELECT l.req_id, l.user_id, CAST(l.ts AS DATE) AS day, l.tok_in, l.tok_out, l.bytes_in, l.bytes_out,
           u.quota_req_day AS q1, u.quota_tok_in AS q2, u.quota_tok_out AS q3, u.quota_bytes_in AS q4, u.quota_bytes_out AS q5,
           row_number() OVER (PARTITION BY l.user_id, CAST(l.ts AS DATE) ORDER BY l.ts, l.req_id) AS rn
    FROM {LOG_SQL} l LEFT JOIN {USERS_SQL} u ON u.id = l.user_id),
  r AS (
    SELECT d.user_id, d.day, d.rn, d.req_id, {_adm_ok('')} AS ok, {_adm_cols('')} FROM d WHERE d.rn = 1
    UNION ALL
    SELECT d.user_id, d.day, d.rn, d.req_id, {_adm_ok('r.')} AS ok, {_adm_cols('r.')}
    FROM r JOIN d ON d.user_id = r.user_id AND d.day = r.day AND d.rn = r.rn + 1)
  SELECT req_id, user_id, day, ok AS admitted FROM r""")
def g8_quota_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.quota_admission(derived.request_log(spark, sf_dir), derived.users(spark, sf_dir))


def _lock_sql(key: str, max_fails: int, lock_s: int) -> str:
    out = (f"CASE WHEN {{u}} IS NOT NULL AND a.ts < {{u}} THEN 'refused' WHEN a.ok THEN 'ok' "
           f"WHEN {{f}} + 1 >= {max_fails} THEN 'locked' ELSE 'fail' END")
    fails = "CASE WHEN {u} IS NOT NULL AND a.ts < {u} THEN {f} WHEN a.ok THEN 0 WHEN {f} + 1 >= %d THEN 0 ELSE {f} + 1 END" % max_fails
    until = ("CASE WHEN {u} IS NOT NULL AND a.ts < {u} THEN {u} WHEN a.ok THEN NULL "
             "WHEN {f} + 1 >= %d THEN a.ts + INTERVAL %d SECOND ELSE NULL END") % (max_fails, lock_s)
    init = dict(u="CAST(NULL AS TIMESTAMP)", f="0")
    step = dict(u="r.until", f="r.fails")
    return f"""WITH RECURSIVE a0 AS (
    SELECT attempt_id, ts, ok, {key} AS key, row_number() OVER (PARTITION BY {key} ORDER BY ts, attempt_id) AS rn
    FROM {derived.login_attempts_sql()}),
  r AS (
    SELECT a.key, a.rn, a.attempt_id, {out.format(**init)} AS outcome, {fails.format(**init)} AS fails, {until.format(**init)} AS until
    FROM a0 a WHERE a.rn = 1
    UNION ALL
    SELECT a.key, a.rn, a.attempt_id, {out.format(**step)}, {fails.format(**step)}, {until.format(**step)}
    FROM r JOIN a0 a ON a.key = r.key AND a.rn = r.rn + 1)
  SELECT attempt_id, key, outcome, CASE WHEN outcome IN ('refused', 'locked') THEN until END AS locked_until FROM r"""


register("i7_lockout_user", _lock_sql("username", FO.USER_MAX_FAILS, FO.USER_LOCK_S))(
    lambda spark, sf_dir: FO.lockout(derived.login_attempts(spark, sf_dir), "username"))
register("i7_lockout_ip", _lock_sql("ip", FO.IP_MAX_FAILS, FO.IP_LOCK_S))(
    lambda spark, sf_dir: FO.lockout(derived.login_attempts(spark, sf_dir), "ip", FO.IP_MAX_FAILS, FO.IP_LOCK_S))


# all attempts in one recursion: a map from user and address to its counter and lock
BOTH_LOCK_SQL = f"""WITH RECURSIVE a AS MATERIALIZED (
    SELECT attempt_id, ts, ok, username, ip, 'u' || username AS uk, 'i' || ip AS ik,
           row_number() OVER (ORDER BY ts, attempt_id) AS rn FROM {derived.shared_logins_sql()}),
  r AS (
    SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS attempt_id, CAST(NULL AS VARCHAR) AS username, CAST(NULL AS VARCHAR) AS ip,
           CAST(NULL AS VARCHAR) AS outcome, CAST(MAP {{}} AS MAP(VARCHAR, STRUCT(f INTEGER, t TIMESTAMP))) AS m
    UNION ALL
    SELECT rn, attempt_id, username, ip, outcome,
           CASE WHEN outcome = 'refused' THEN m
                WHEN outcome = 'ok' THEN map_concat(m, MAP {{uk: {{'f': 0, 't': CAST(NULL AS TIMESTAMP)}}, ik: {{'f': 0, 't': CAST(NULL AS TIMESTAMP)}}}})
                ELSE map_concat(m, MAP {{uk: {{'f': CASE WHEN ul THEN 0 ELSE uf END, 't': CASE WHEN ul THEN ts + INTERVAL {FO.USER_LOCK_S} SECOND END}},
                                         ik: {{'f': CASE WHEN il THEN 0 ELSE "if" END, 't': CASE WHEN il THEN ts + INTERVAL {FO.IP_LOCK_S} SECOND END}}}}) END AS m
    FROM (SELECT *, CASE WHEN refused THEN 'refused' WHEN ok THEN 'ok' WHEN ul AND il THEN 'locked_both' WHEN ul THEN 'locked_user'
                         WHEN il THEN 'locked_ip' ELSE 'fail' END AS outcome
          FROM (SELECT *, uf >= {FO.USER_MAX_FAILS} AS ul, "if" >= {FO.IP_MAX_FAILS} AS il
                FROM (SELECT a.*, r.m, coalesce(r.m[a.uk].t > a.ts, false) OR coalesce(r.m[a.ik].t > a.ts, false) AS refused,
                             coalesce(r.m[a.uk].f, 0) + 1 AS uf, coalesce(r.m[a.ik].f, 0) + 1 AS "if"
                      FROM r JOIN a ON a.rn = r.rn + 1))))
  SELECT attempt_id, username, ip, outcome FROM r WHERE rn > 0"""


@register("i7_lockout_both", BOTH_LOCK_SQL)
def i7_lockout_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and address locks at once, on attempts where users share addresses."""
    return FO.lockout_both(derived.shared_logins(spark, sf_dir))


def _throttle_sql(seconds: int) -> str:
    return f"""WITH RECURSIVE e AS (
    SELECT req_id AS event_id, split_part(host, ':', 1) AS key, ts FROM {LOG_SQL}),
  firsts AS (SELECT key, ts, min(event_id) AS event_id FROM e GROUP BY key, ts),
  nx AS (SELECT event_id, first_value(event_id) OVER (PARTITION BY key ORDER BY ts
           RANGE BETWEEN INTERVAL {seconds} SECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS next_id FROM firsts),
  r AS (SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS rn FROM firsts) WHERE rn = 1
        UNION ALL SELECT c.next_id FROM r JOIN nx c ON c.event_id = r.event_id WHERE c.next_id IS NOT NULL)
  SELECT e.event_id, e.key, e.ts FROM r JOIN e ON e.event_id = r.event_id"""


def _throttle(seconds: int):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = derived.request_log(spark, sf_dir).withColumn("key", AC.bare_host(F.col("host")))
        return FO.throttle(events, "key", window_s=seconds, id_col="req_id")
    return build


# all events, under the default window and under one that holds many events of a key
register("i8_throttle", _throttle_sql(FO.THROTTLE_WINDOW_S))(_throttle(FO.THROTTLE_WINDOW_S))
register("i8_throttle_wide", _throttle_sql(6 * 3600))(_throttle(6 * 3600))


# --- D7: chunked replies ------------------------------------------------------------------------------
from spanshield.operators import stream_restore as SR  # noqa: E402


@register("d7_detokenize_stream", _detok_sql(True))
def d7_detokenize_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies cut into 1..13-byte chunks and restored as a stream; equals D5 on the whole reply."""
    tokenized = tokenized_table(spark, sf_dir)
    rep = replies_of(tokenized)
    vault = V.build_vault(V.token_entries(tokenized))
    chunks = SR.split_into_chunks(rep)
    sessions = rep.select(F.col("msg_id").alias("stream_id"), "session_key")
    return SR.detokenize_stream(chunks, sessions, vault).select(F.col("stream_id").alias("msg_id"), "restored")


# --- B9, C6: JSON bodies ----------------------------------------------------------------------------
from spanshield.operators import json_scan as JS  # noqa: E402


def json_messages(spark, sf_dir):
    """Every document as the user content of a chat request body, plus the example messages
    (some JSON, most plain text)."""
    m = derived.messages(spark, sf_dir, with_fixtures=False)
    body = F.concat(F.lit('{"model":"m","messages":[{"role":"user","content":'), _json_str(F.col("body")),
                    F.lit('}],"user":'), _json_str(F.coalesce(F.col("user_id"), F.lit("anon"))), F.lit("}"))
    cols = ["msg_id", "user_id", "host", "path", "ts"]
    d = m.select(*cols, body.alias("body")).unionByName(fixture_df(spark, "messages").select(*cols, "body"))
    return d.unionByName(fixture_df(spark, "json_messages"))


JSON_MSG_SQL = f"""(SELECT msg_id, user_id, host, path, ts, '{{"model":"m","messages":[{{"role":"user","content":' || to_json(body)
    || '}}],"user":' || to_json(coalesce(user_id, 'anon')) || '}}' AS body FROM {derived.messages_sql(with_fixtures=False)}
  UNION ALL SELECT msg_id, user_id, host, path, ts, body FROM {fixture_sql('messages')}
  UNION ALL SELECT * FROM {fixture_sql('json_messages')})"""
JSON_VALS_SQL = f"""(SELECT row_number() OVER (ORDER BY msg_id, value_ord) AS id, msg_id, value_ord, text FROM (
    SELECT m.msg_id, CAST(row_number() OVER (PARTITION BY m.msg_id ORDER BY t.id) - 1 AS INTEGER) AS value_ord,
           json_extract_string(t.value, '$') AS text
    FROM {JSON_MSG_SQL} m, json_tree(m.body) t WHERE json_valid(m.body) AND t.type = 'VARCHAR'
    UNION ALL SELECT msg_id, -1 AS value_ord, body AS text FROM {JSON_MSG_SQL} WHERE NOT json_valid(body)))"""


@register("b9_scan_json", f"""SELECT v.msg_id, v.value_ord, s.ord AS det_ord, s.start, s."end", s.type, s.text
  FROM ({O.scan_sql(f"(SELECT id, text FROM {JSON_VALS_SQL})")}) s JOIN {JSON_VALS_SQL} v ON v.id = s.id""")
def b9_scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JS.scan_json(json_messages(spark, sf_dir))


@register("c6_tokenize_json", f"""SELECT v.msg_id, v.value_ord, r.out AS new_value FROM {O.rebuild_sql(
    f"(SELECT id, text FROM {JSON_VALS_SQL})",
    f'''(SELECT v.id, s.start, s."end", '[' || {O.type_prefix('s.type')} || '_' || left(sha256(s.text || m.skey), {O.P.TOKEN_HEX_LEN}) || ']' AS repl
        FROM ({O.scan_sql(f"(SELECT id, text FROM {JSON_VALS_SQL})")}) s JOIN {JSON_VALS_SQL} v ON v.id = s.id
        JOIN (SELECT msg_id, 'map:session:' || coalesce(user_id, 'anon') || ':' || host AS skey FROM {JSON_MSG_SQL}) m
          ON m.msg_id = v.msg_id)''', "out")} r JOIN {JSON_VALS_SQL} v ON v.id = r.id
  WHERE r.out <> v.text""")
def c6_tokenize_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenized string values (decoded back from the rewritten body) for values that changed."""
    t = JS.tokenize_json(json_messages(spark, sf_dir))
    vals = t.select("msg_id", JS.json_values(F.col("tokenized")).alias("_n"), JS.json_values(F.col("body")).alias("_o"))
    pairs = vals.select("msg_id", F.arrays_zip("_n", "_o").alias("_z"))
    ex = explode_spans(pairs, "_z", ["msg_id"]).select(
        "msg_id", F.col("_e._n.ord").alias("value_ord"), F.col("_e._n.value").alias("new_value"),
        F.col("_e._o.value").alias("old_value"))
    return ex.where(F.col("new_value") != F.col("old_value")).select("msg_id", "value_ord", "new_value")


JSON_TOKENS_SQL = f"""(SELECT v.msg_id, v.value_ord, s.ord AS det_ord, s.type, s.text AS value, s.masked, m.skey AS session_key, m.ts,
    m.user_id, m.host, m.path, {O.type_prefix('s.type')} || '_' || left(sha256(s.text || m.skey), {O.P.TOKEN_HEX_LEN}) AS core
  FROM ({O.scan_sql(f"(SELECT id, text FROM {JSON_VALS_SQL})")}) s JOIN {JSON_VALS_SQL} v ON v.id = s.id
  JOIN (SELECT *, 'map:session:' || coalesce(user_id, 'anon') || ':' || host AS skey FROM {JSON_MSG_SQL}) m ON m.msg_id = v.msg_id)"""
# detections numbered over a body's values, as one prompt list sees them; a rejected token goes everywhere
_JSON_DETS_SQL = f"(SELECT msg_id, row_number() OVER (PARTITION BY msg_id ORDER BY value_ord, det_ord) - 1 AS ord, type, value AS text, core FROM {JSON_TOKENS_SQL})"
_JSON_GONE_SQL = f"(SELECT DISTINCT msg_id, core FROM {keep_sql(_JSON_DETS_SQL, requests_sql(_JSON_DETS_SQL, JSON_MSG_SQL))} WHERE NOT keep)"


@register("c7_restore_json", f"""SELECT v.msg_id, v.value_ord, r.out AS new_value FROM {O.rebuild_sql(
    f"(SELECT id, text FROM {JSON_VALS_SQL})",
    f'''(SELECT id, start, "end", '[' || core || ']' AS repl FROM (
        SELECT v.id, v.msg_id, s.start, s."end", {O.type_prefix('s.type')} || '_' || left(sha256(s.text || m.skey), {O.P.TOKEN_HEX_LEN}) AS core
        FROM ({O.scan_sql(f"(SELECT id, text FROM {JSON_VALS_SQL})")}) s JOIN {JSON_VALS_SQL} v ON v.id = s.id
        JOIN (SELECT msg_id, 'map:session:' || coalesce(user_id, 'anon') || ':' || host AS skey FROM {JSON_MSG_SQL}) m
          ON m.msg_id = v.msg_id) t ANTI JOIN {_JSON_GONE_SQL} g ON g.msg_id = t.msg_id AND g.core = t.core)''', "out")} r
  JOIN {JSON_VALS_SQL} v ON v.id = r.id WHERE r.out <> v.text""")
def c7_restore_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenized values of JSON bodies from which the judge's rejections are put back, JSON-escaped."""
    m = JS.with_json_detections(json_messages(spark, sf_dir))
    t = JS.restore_rejected_json(m, rejected_by_judge(m))
    vals = t.select("msg_id", JS.json_values(F.col("tokenized")).alias("_n"), JS.json_values(F.col("body")).alias("_o"))
    ex = explode_spans(vals.select("msg_id", F.arrays_zip("_n", "_o").alias("_z")), "_z", ["msg_id"]).select(
        "msg_id", F.col("_e._n.ord").alias("value_ord"), F.col("_e._n.value").alias("new_value"), F.col("_e._o.value").alias("old_value"))
    return ex.where(F.col("new_value") != F.col("old_value")).drop("old_value")


_JSON_RANK = "ORDER BY ts DESC, msg_id DESC, value_ord DESC, det_ord DESC"


def json_entries(spark, sf_dir):
    return JS.json_detections(json_messages(spark, sf_dir), keep=("msg_id", "ts"))


@register("d1_vault_json", f"""SELECT core, CAST(NULL AS VARCHAR) AS session_key, value, stored_at, stored_at AS last_access FROM (
    SELECT core, value, max(ts) OVER (PARTITION BY core) AS stored_at, row_number() OVER (PARTITION BY core {_JSON_RANK}) AS rn
    FROM {JSON_TOKENS_SQL}) WHERE rn = 1
  UNION ALL
  SELECT core, session_key, value, stored_at, stored_at AS last_access FROM (
    SELECT core, session_key, value, max(ts) OVER (PARTITION BY session_key, core) AS stored_at,
           row_number() OVER (PARTITION BY session_key, core {_JSON_RANK}) AS rn FROM {JSON_TOKENS_SQL}) WHERE rn = 1""")
def d1_vault_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.build_vault(json_entries(spark, sf_dir))


@register("d5_detokenize_json", f"SELECT msg_id, value_ord, text AS value FROM {JSON_VALS_SQL}")
def d5_detokenize_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenized JSON bodies restored from the vault that their own detections filled: every string
    value comes back, and the body is JSON again."""
    m = json_messages(spark, sf_dir)
    t = JS.tokenize_json(m).select("msg_id", R.session_key(F.col("user_id"), F.col("host")).alias("session_key"), F.col("tokenized").alias("body"))
    # bodies and entries are read more than once below and dear to compute
    t, entries = stored(t, "json-tokenized"), stored(json_entries(spark, sf_dir), "json-entries")
    back = V.detokenize(t, V.build_vault(entries), unknown=None, json_bodies=True)
    vals = back.select("msg_id", JS.json_values(F.col("restored")).alias("_v"))
    return explode_spans(vals, "_v", ["msg_id"]).select("msg_id", F.col("_e.ord").alias("value_ord"), F.col("_e.value").alias("value"))


@register("f1_events_json", f"""SELECT msg_id, value_ord, det_ord, user_id, host AS resource, type AS violation_type,
    type || ': masked=' || masked || ' token=[' || core || ']' AS masked_context, '[' || core || ']' AS token, path AS request_path, ts FROM {JSON_TOKENS_SQL}""")
def f1_events_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = JS.json_detections(json_messages(spark, sf_dir), keep=("msg_id", "user_id", "host", "path", "ts"))
    return d.select("msg_id", "ord.value_ord", "ord.det_ord", "user_id", F.col("host").alias("resource"), F.col("type").alias("violation_type"),
                    F.concat("type", F.lit(": masked="), "masked", F.lit(" token="), "token").alias("masked_context"), "token",
                    F.col("path").alias("request_path"), "ts")


# --- A1, B7 -------------------------------------------------------------------------------------------
@register("a1_read_messages", "SELECT doc_id, text, lang FROM documents")
def a1_read_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanshield.sources.tables import read_messages
    return read_messages(spark, f"{sf_dir.rstrip('/')}/documents.parquet", body_col="text").select("doc_id", "text", "lang")


# B7 is off by default (as in the reference). RE2's word boundary is ASCII: the oracle spells the
# Unicode one out as a class and finds each match anew from the end of the one before.
_WORD = "\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}"
_B7_CORE = "(?i:" + "|".join(O.P.COMPANY_FORMS) + ")" + f"{O.P.WS}+[\"«]?(?i:[А-ЯЁA-Z])[{_WORD}{O.P.WS_CHARS}\\-.]{{1,40}}"
_B7_RE = f"(^|[^{_WORD}])({_B7_CORE})"


def _mask_company_sql(s: str) -> str:
    legal = f"regexp_extract({s}, '^[^ \"«]*')"
    after = f"substring({s}, length({legal}) + 2)"
    name = f"trim({after}, '\"«»')"
    quote = f"(CASE WHEN left({after}, 1) IN ('\"', '«') THEN left({after}, 1) ELSE '' END)"
    return (f"(CASE WHEN length({legal}) < length({s}) THEN {legal} || ' ' || {quote} || coalesce(nullif(left({name}, 1), ''), '*') || '***' "
            f"ELSE left({s}, 4) || '***' END)")


@register("b7_company", f"""WITH RECURSIVE src AS (SELECT id, text FROM {MSG_SRC} WHERE text IS NOT NULL),
  f AS (SELECT id, text, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS "end", CAST(NULL AS VARCHAR) AS hit FROM src
    UNION ALL
    SELECT id, text, pos + length(pre) AS start, pos + length(pre) + length(hit) AS "end", hit FROM (
      SELECT id, text, hit, pre, "end" + strpos(substring(text, "end" + 1), pre || hit) - 1 AS pos FROM (
        SELECT id, text, "end", regexp_extract(substring(text, "end" + 1), {O.q(_B7_RE)}, 1) AS pre,
               regexp_extract(substring(text, "end" + 1), {O.q(_B7_RE)}, 2) AS hit FROM f) WHERE hit <> ''))
  SELECT id AS msg_id, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", 'PII_COMPANY' AS type, hit AS text,
         {_mask_company_sql('hit')} AS masked FROM f WHERE hit IS NOT NULL""")
def b7_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _single("company")(spark, sf_dir)
