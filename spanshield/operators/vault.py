"""Token vault and restoration.

The vault is a table ``core, session_key, value, stored_at, last_access`` (``session_key`` null
= the global scope). Building and upserting are hash aggregations on ``core`` (partial
aggregation map-side); ``vault_store`` keeps it as a persistent table. Restoration joins the cores
found in replies with the vault; replies without a token pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanshield import patterns as P
from spanshield.functions.spans import explode_spans, find_spans, guarded, rebuild
from spanshield.operators.detect import cached_column

TTL_SECONDS = 2_592_000  # 30 days
VAULT_COLS = ["core", "session_key", "value", "stored_at", "last_access"]


def token_entries(tokenized: DataFrame, ts_col: str = "ts", id_col: str = "msg_id",
                  det_col: str = "detections") -> DataFrame:
    """One row per (message, detection): core, session_key, value, ts, full hash."""
    ex = explode_spans(tokenized, det_col, [id_col, ts_col, "session_key"], pos="ord")
    return ex.select(id_col, F.col(ts_col).alias("ts"), "session_key", "ord", F.col("_e.core").alias("core"),
                     F.col("_e.text").alias("value"), F.col("_e.type").alias("type"), F.col("_e.hash").alias("hash"))


def build_vault(entries: DataFrame, per_session: bool = True) -> DataFrame:
    """Core -> value, last write wins (by ts, then message id, then ordinal).

    Rows with ``session_key`` null are the global scope; with ``per_session`` the session-scoped
    rows are produced too. Both come from one aggregation of the entries. A core that stands for
    more than one value is left out of the global scope: its values are found by session.
    """
    order = F.struct("ts", "msg_id", "ord")
    per = entries.groupBy("session_key", "core").agg(
        F.max(F.struct(order.alias("at"), F.col("value"))).alias("last"), F.max("ts").alias("stored_at"),
        F.min("value").alias("lo"), F.max("value").alias("hi"))
    # a session's last write and the scope's: the one group of the core over all its sessions
    scoped = per.groupBy("core").agg(
        F.max("last").alias("last"), F.max("stored_at").alias("stored_at"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    g = scoped.where(F.col("lo") == F.col("hi")).select(
        "core", F.lit(None).cast("string").alias("session_key"), F.col("last.value").alias("value"), "stored_at",
        F.col("stored_at").alias("last_access"))
    if not per_session:
        return g
    s = per.select("core", "session_key", F.col("last.value").alias("value"), "stored_at", F.col("stored_at").alias("last_access"))
    return g.unionByName(s)


def write_vault(vault: DataFrame, updates: DataFrame) -> DataFrame:
    """A5: upsert (last write wins per (session_key, core)); access time refreshed."""
    both = vault.select(*VAULT_COLS).unionByName(updates.select(*VAULT_COLS))
    order = F.struct(F.col("stored_at"), F.col("value"))
    return (both.groupBy("session_key", "core")
            .agg(F.max_by("value", order).alias("value"), F.max("stored_at").alias("stored_at"),
                 F.max("last_access").alias("last_access"))
            .select(*VAULT_COLS))


def expire_vault(vault: DataFrame, now: Column, ttl_seconds: int = TTL_SECONDS, hash_ttl: bool = False) -> DataFrame:
    """Drop entries not written or read within the TTL (30 days).

    ``hash_ttl=True`` reproduces the reference's scope-wide TTL: a scope (global or one session)
    lives as long as its most recent access, and all its entries with it.
    """
    last = F.col("last_access")
    if hash_ttl:
        # the newest access of a scope by partial aggregation: the global scope is one hot key
        newest = vault.groupBy("session_key").agg(F.max("last_access").alias("_newest")) \
            .where(F.col("_newest") >= now - F.make_interval(secs=F.lit(ttl_seconds))).withColumnRenamed("session_key", "_scope")
        return vault.join(newest, F.col("session_key").eqNullSafe(F.col("_scope")), "left_semi")
    return vault.where(last >= now - F.make_interval(secs=F.lit(ttl_seconds)))


def find_tokens(text: Column) -> Column:
    """D3: all written token forms as ``array<struct<start, end, text, core>>`` (leftmost, longest)."""
    spans = guarded(F.contains(text, F.lit("_")), find_spans(text, P.TOKEN_ANY_RE))  # every form has "_"
    return F.transform(spans, lambda s: s.withField("core", token_core(s["text"])))


def token_core(token: Column) -> Column:
    """Canonical ``TYPE_hex`` of any written form, else the input."""
    core = F.regexp_extract(token, P.TOKEN_CORE_RE, 0)
    return F.when(core == "", token).otherwise(core)


def explode_tokens(df: DataFrame, text_col: str, keep=("msg_id",)) -> DataFrame:
    t = df.select(*keep, cached_column(("find_tokens", text_col), lambda: find_tokens(F.col(text_col))).alias("_toks"))
    return explode_spans(t, "_toks", list(keep), pos="ord") \
        .select(*keep, "ord", F.col("_e.start").alias("start"), F.col("_e.end").alias("end"),
                F.col("_e.text").alias("token_text"), F.col("_e.core").alias("core"))


def has_token(text: Column) -> Column:
    """Whether a text may hold a token form; every form holds a core."""
    return F.coalesce((F.contains(text, F.lit("_"))) & text.rlike(P.TOKEN_CORE_RE), F.lit(False))


def detokenize(replies: DataFrame, vault: DataFrame | tuple[DataFrame, DataFrame], text_col: str = "body",
               id_col: str = "msg_id", session_col: str = "session_key", request_map: DataFrame | None = None,
               unknown: str | None = P.REDACTED, out: str = "restored",
               num_partitions: int | None = None, json_bodies: bool = False, split: bool = True) -> DataFrame:
    """D5 (and D6 with ``unknown=None``): replace every token by its value.

    Lookup order: request map -> global vault -> session vault -> ``[REDACTED]`` (D6 keeps the
    token text). ``vault``: one table, or the two scopes apart (``VaultTables.scopes``).
    ``json_bodies``: in a body that is JSON a value is written JSON-escaped, so the body stays JSON.

    Plan: bodies without a token pass by without any exchange. The others are hash-partitioned by id
    once; the token rows derived from them keep that partitioning, so the regroup by id and the join
    back add no further shuffle of bodies. Only token rows (id, span, core) meet the vault, and only
    vault rows of referenced cores survive the join. ``split=False`` reads the replies once, for
    input that is dear to compute again.
    """
    spark = replies.sparkSession
    n = num_partitions or max(spark.sparkContext.defaultParallelism,
                              int(spark.conf.get("spark.sql.shuffle.partitions")))
    toks_col = cached_column(("find_tokens", text_col), lambda: find_tokens(F.col(text_col)))
    plain = replies.where(~has_token(F.col(text_col))).withColumn(out, F.col(text_col)) if split else None
    r = (replies.where(has_token(F.col(text_col))) if split else replies).repartition(n, id_col).withColumn("_toks", toks_col)
    if json_bodies:
        r = r.withColumn("_json", F.try_parse_json(text_col).isNotNull())
    more = ["_json"] if json_bodies else []
    toks = explode_spans(r, "_toks", [id_col, session_col, *more]) \
        .select(id_col, session_col, *more, "_e.start", "_e.end", F.col("_e.text").alias("token_text"), "_e.core")
    glob, sess = vault if isinstance(vault, tuple) else (vault.where(F.col("session_key").isNull()), vault.where(F.col("session_key").isNotNull()))
    glob = glob.select("core", F.col("value").alias("v_global"))
    sess = sess.select(F.col("session_key").alias(session_col), "core", F.col("value").alias("v_session"))
    j = toks.join(glob, "core", "left").join(sess, [session_col, "core"], "left")
    vals = [F.col("v_global"), F.col("v_session")]
    if request_map is not None:
        rm = request_map.select(id_col, "core", F.col("value").alias("v_request"))
        j = j.join(rm, [id_col, "core"], "left")
        vals = [F.col("v_request")] + vals
    fallback = F.lit(unknown) if unknown is not None else F.col("token_text")
    value = F.coalesce(*vals, fallback)
    if json_bodies:
        quoted = F.to_json(F.array(F.coalesce(*vals)))   # ["..."]
        value = F.when(F.col("_json") & F.coalesce(*vals).isNotNull(), F.substring(quoted, F.lit(3), F.length(quoted) - 4)).otherwise(value)
    per_msg = j.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", value.alias("value")))).alias("_repl"))
    rebuilt = cached_column(("rebuild", text_col, "_repl", "value"),
                            lambda: F.when(F.col("_repl").isNull(), F.col(text_col))
                            .otherwise(rebuild(F.col(text_col), F.col("_repl"), "value")))
    # full outer = left outer here (every token row comes from a reply); unlike a left join it lets
    # Catalyst infer no not-null filter into the token branch, so both branches keep the identical
    # reply exchange and Spark reuses it instead of recomputing the replies
    restored = r.join(per_msg, id_col, "full_outer").withColumn(out, rebuilt).drop("_toks", "_repl", "_json")
    return restored if plain is None else restored.unionByName(plain)


def vault_collisions(entries: DataFrame) -> DataFrame:
    """Cores that stand for more than one value (only short tokens, as the 6-digit form, collide in practice)."""
    return (entries.groupBy("core")
            .agg(F.countDistinct("value").alias("n_values"), F.countDistinct("hash").alias("n_hashes"))
            .where(F.col("n_values") > 1))
