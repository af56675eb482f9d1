"""Usage, quotas and reports.

Hash aggregations keyed by user (and day); joins of the user dimension with aggregated usage are
one row per user on each side, so Catalyst/AQE choose broadcast or sort-merge by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanshield.functions import formats as FM

USAGE_METRICS = ["req", "tok_in", "tok_out", "bytes_in", "bytes_out"]
QUOTA_COLS = ["quota_req_day", "quota_tok_in", "quota_tok_out", "quota_bytes_in", "quota_bytes_out"]
# Quota names in check order, and report rows (label, usage column, quota column).
QUOTA_NAMES = ["req_day", "tok_in", "tok_out", "bytes_in", "bytes_out"]
REPORT_ROWS = [("Requests", "req", "quota_req_day", "int"), ("Tokens In", "tok_in", "quota_tok_in", "tokens"),
               ("Tokens Out", "tok_out", "quota_tok_out", "tokens"), ("Bytes In", "bytes_in", "quota_bytes_in", "bytes"),
               ("Bytes Out", "bytes_out", "quota_bytes_out", "bytes")]


def usage_daily(log: DataFrame) -> DataFrame:
    """Per (user, UTC day): requests, tokens, bytes."""
    return (log.groupBy("user_id", F.to_date("ts").alias("day"))
            .agg(F.count(F.lit(1)).alias("req"), *[F.sum(c).cast("long").alias(c) for c in USAGE_METRICS[1:]]))


def write_usage(usage: DataFrame, delta: DataFrame) -> DataFrame:
    """Add-on-conflict upsert keyed by (user, day)."""
    both = usage.select("user_id", "day", *USAGE_METRICS).unionByName(delta.select("user_id", "day", *USAGE_METRICS))
    return both.groupBy("user_id", "day").agg(*[F.sum(c).cast("long").alias(c) for c in USAGE_METRICS])


def usage_total(usage: DataFrame) -> DataFrame:
    """All-time sums per user, 0 when absent."""
    return usage.groupBy("user_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in USAGE_METRICS])


def usage_on_day(users: DataFrame, usage: DataFrame, day) -> DataFrame:
    """Every user's row for ``day``, zeros when absent."""
    d = usage.where(F.col("day") == F.lit(day).cast("date")).select("user_id", *USAGE_METRICS)
    j = users.select(F.col("id").alias("user_id")).join(d, "user_id", "left")
    return j.select("user_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in USAGE_METRICS])


def user_metrics(users: DataFrame, usage: DataFrame) -> DataFrame:
    """Every user ordered by name, with all-time totals and formatted columns."""
    tot = usage_total(usage).withColumnRenamed("user_id", "id")
    j = users.select("id", "username", "status", "role").join(tot, "id", "left")
    out = j.select("id", "username", "status", "role",
                   *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in USAGE_METRICS])
    return out.select("*", FM.format_tokens(F.col("tok_in")).alias("tok_in_fmt"),
                      FM.format_tokens(F.col("tok_out")).alias("tok_out_fmt"),
                      FM.format_bytes(F.col("bytes_in")).alias("bytes_in_fmt"),
                      FM.format_bytes(F.col("bytes_out")).alias("bytes_out_fmt")).orderBy("username")


def quota_status(u: dict, used: dict) -> Column:
    """First limit (in check order) whose usage is >= the limit; else ``ok``. Null limit = unlimited."""
    expr = None
    for name, qc, uc in zip(QUOTA_NAMES, QUOTA_COLS, USAGE_METRICS):
        cond = u[qc].isNotNull() & (used[uc] >= u[qc])
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit("ok"))


def check_quota(users: DataFrame, usage_today: DataFrame) -> DataFrame:
    """Quota pre-check for every user against one day's usage."""
    j = users.join(usage_today.withColumnRenamed("user_id", "id"), "id", "left")
    used = {c: F.coalesce(F.col(c), F.lit(0)) for c in USAGE_METRICS}
    cols = {c: F.col(c) for c in QUOTA_COLS}
    return j.select("id", "username", quota_status(cols, used).alias("quota_status"))


def quota_report(users: DataFrame, usage_today: DataFrame) -> DataFrame:
    """Per user and metric: limit, used today, percent and an 8-cell bar."""
    j = users.join(usage_today.withColumnRenamed("user_id", "id"), "id", "left")
    stack = F.explode(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(label).alias("metric"), F.col(qc).alias("lim"),
                 F.coalesce(F.col(uc), F.lit(0)).cast("long").alias("used"), F.lit(kind).alias("kind"))
        for i, (label, uc, qc, kind) in enumerate(REPORT_ROWS)]))
    r = j.select("id", "username", stack.alias("r")).select("id", "username", "r.*")
    used_txt = (F.when(F.col("kind") == "tokens", FM.format_tokens(F.col("used")))
                .when(F.col("kind") == "bytes", FM.format_bytes(F.col("used")))
                .otherwise(F.col("used").cast("string")))
    return r.select("id", "username", "pos", "metric", FM.format_optional(F.col("lim")).alias("limit_text"),
                    used_txt.alias("used_text"), FM.percent_text(F.col("used"), F.col("lim")).alias("pct"),
                    FM.progress_bar(FM.percent_value(F.col("used"), F.col("lim"))).alias("bar"))


def login_counters(attempts: DataFrame) -> DataFrame:
    """Per user, successful and failed logins and the last successful time."""
    return attempts.groupBy("username").agg(
        F.count_if(F.col("ok")).cast("long").alias("n_ok"),
        F.count_if(~F.col("ok")).cast("long").alias("n_fail"),
        F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_ok"))


def read_users(users: DataFrame, username: str | None = None, user_id: str | None = None) -> DataFrame:
    """A3: user dimension ordered by name; optional lookup by name or id."""
    if username is not None:
        users = users.where(F.col("username") == username)
    if user_id is not None:
        users = users.where(F.col("id") == user_id)
    return users.orderBy("username")


def delete_users(users: DataFrame, usage: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete users and cascade to their usage rows (anti-joins)."""
    ids = ids.select(F.col("id"))
    return (users.join(ids, "id", "left_anti"),
            usage.join(ids.withColumnRenamed("id", "user_id"), "user_id", "left_anti"))


def update_users(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply role / status / quota changes.

    ``changes``: ``id`` plus optional ``role``, ``status`` and ``set_quota`` (bool) with the five
    quota columns; a quota update overwrites all five (absent -> null = unlimited).
    """
    c = changes.select("id", *[F.col(x).alias("new_" + x) for x in changes.columns if x != "id"])
    j = users.join(c, "id", "left")
    out = []
    for col in users.columns:
        if col in ("role", "status") and ("new_" + col) in c.columns:
            out.append(F.coalesce(F.col("new_" + col), F.col(col)).alias(col))
        elif col in QUOTA_COLS and "new_set_quota" in c.columns:
            newv = F.col("new_" + col) if ("new_" + col) in c.columns else F.lit(None).cast("long")
            out.append(F.when(F.coalesce(F.col("new_set_quota"), F.lit(False)), newv).otherwise(F.col(col)).alias(col))
        else:
            out.append(F.col(col))
    return j.select(*out)


def billing_ledger_monthly(log: DataFrame) -> DataFrame:
    """G13 (design-only in the reference): monthly roll-up per user of the request ledger."""
    return (log.groupBy("user_id", F.date_trunc("month", "ts").alias("month"))
            .agg(F.count(F.lit(1)).alias("requests"),
                 *[F.sum(c).cast("long").alias(c) for c in USAGE_METRICS[1:]],
                 F.count_if(F.col("status") >= 400).cast("long").alias("failed")))


# --- G1, G2, G12: usage from provider bodies --------------------------------------------------------
def _u64(v: Column) -> Column:
    """A JSON unsigned integer (as the reference's ``as_u64``): integers >= 0 only, no floats or strings."""
    return F.when((F.schema_of_variant(v) == "BIGINT") & (F.variant_get(v, "$", "bigint") >= 0),
                  F.variant_get(v, "$", "bigint"))


def _is_object(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def usage_record(v: Column) -> Column:
    """``struct<prompt, completion, model>`` from a parsed provider body, or null (no record).

    ``usage.prompt_tokens/completion_tokens`` if either is present, else
    ``usage.input_tokens/output_tokens``; ``model`` only when it is a string.
    """
    u = F.try_variant_get(v, "$.usage", "variant")
    p1, c1 = _u64(F.try_variant_get(u, "$.prompt_tokens", "variant")), _u64(F.try_variant_get(u, "$.completion_tokens", "variant"))
    p2, c2 = _u64(F.try_variant_get(u, "$.input_tokens", "variant")), _u64(F.try_variant_get(u, "$.output_tokens", "variant"))
    m = F.try_variant_get(v, "$.model", "variant")
    model = F.when(F.schema_of_variant(m) == "STRING", F.variant_get(m, "$", "string"))
    first = p1.isNotNull() | c1.isNotNull()
    second = p2.isNotNull() | c2.isNotNull()
    rec = F.struct(F.when(first, p1).otherwise(p2).alias("prompt"), F.when(first, c1).otherwise(c2).alias("completion"),
                   model.alias("model"))
    ok = v.isNotNull() & _is_object(v) & _is_object(u) & (first | second)
    return F.when(F.coalesce(ok, F.lit(False)), rec)


def parse_usage(df: DataFrame, body_col: str = "body", out: str = "usage") -> DataFrame:
    """G1: usage record of each JSON body (null when there is none)."""
    return df.withColumn(out, usage_record(F.try_parse_json(F.col(body_col))))


def estimate_tokens(body: Column) -> Column:
    """ceil(bytes of all message contents / 4) (string content, or ``parts[].text``); 0 -> null."""
    v = F.try_parse_json(body)
    msgs = F.try_variant_get(v, "$.messages", "array<variant>")

    def content_bytes(m):
        c = F.try_variant_get(m, "$.content", "variant")
        kind = F.schema_of_variant(c)
        parts = F.try_variant_get(c, "$", "array<variant>")
        part_bytes = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + F.coalesce(F.when(
            F.schema_of_variant(F.try_variant_get(p, "$.text", "variant")) == "STRING",
            F.octet_length(F.try_variant_get(p, "$.text", "string"))), F.lit(0)))
        return (F.when(kind == "STRING", F.octet_length(F.variant_get(c, "$", "string")).cast("long"))
                .when(F.startswith(kind, F.lit("ARRAY")), part_bytes).otherwise(F.lit(0).cast("long")))

    n = F.aggregate(F.transform(msgs, content_bytes), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(n > 0, F.ceil(n / F.lit(4.0)).cast("long"))


def usage_from_stream(sse: Column) -> Column:
    """G12 (design-only in the reference): usage from ``data:`` frames of an SSE reply.

    OpenAI: the last frame carrying usage; Anthropic: ``message_start.message.usage.input_tokens``
    and the last ``message_delta.usage.output_tokens``. Returns ``struct<prompt, completion>``.
    """
    lines = F.split(sse, "\n", -1)
    frames = F.transform(F.filter(lines, lambda ln: F.startswith(ln, F.lit("data: "))),
                         lambda ln: F.try_parse_json(F.substring(ln, 7, 2147483647)))
    recs = F.filter(F.transform(frames, usage_record), lambda r: r.isNotNull())
    last = F.try_element_at(recs, F.lit(-1))

    def typed(t):
        return F.filter(frames, lambda f: F.coalesce(F.try_variant_get(f, "$.type", "string") == t, F.lit(False)))

    starts = typed("message_start")
    deltas = typed("message_delta")
    a_in = F.try_element_at(F.transform(starts, lambda f: _u64(F.try_variant_get(f, "$.message.usage.input_tokens", "variant"))), F.lit(1))
    a_out = F.try_element_at(F.filter(F.transform(deltas, lambda f: _u64(F.try_variant_get(f, "$.usage.output_tokens", "variant"))),
                                  lambda x: x.isNotNull()), F.lit(-1))
    is_anthropic = F.size(starts) > 0
    return F.when(is_anthropic, F.struct(a_in.alias("prompt"), a_out.alias("completion"))) \
        .otherwise(F.struct(last["prompt"].alias("prompt"), last["completion"].alias("completion")))
