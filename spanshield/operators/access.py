"""Access analytics (A2, I1-I6, I9): target resolution, loopback, policies, revocation.

All joins are equi-joins and nothing is counted; Catalyst picks the strategy by the actual sizes. The
allowlist of targets alone is broadcast by name: its hosts are few and hot, and a log dealt out by host
would put each host's bodies into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Loopback names (the last two never match after the ':' split, as in the reference),
# default target port/tls, body size cap, stream marker.
LOOPBACK = ["localhost", "127.0.0.1", "0.0.0.0", "[::1]", "::1"]
DEFAULT_PORT = 443
DEFAULT_TLS = True
MAX_BODY_BYTES = 10 * 1024 * 1024
STREAM_MARKER = '"stream":true'
DEFAULT_ROLE = "user"
# Static access policies (role, path pattern, method or *).
POLICIES = [
    ("admin", "/api/users", "*"),
    ("admin", "/api/users/*", "*"),
    ("admin", "/api/metrics", "*"),
    ("admin", "/api/metrics/*", "*"),
    ("admin", "/api/roles/*", "*"),
    ("admin", "/api/quota/self", "GET"),
    ("user", "/api/quota/self", "GET"),
    ("user", "/api/metrics/self", "GET"),
]
# The allowlist of inspected targets (host, port, tls; null = default).
TARGETS = [("api.deepseek.com", 443, None), ("api.openai.com", 443, None), ("httpbin.org", 80, False)]
# Addresses routed directly (glob patterns) and the private 172.16.0.0/12 range.
DIRECT_GLOBS = ["localhost", "127.*", "10.*", "192.168.*"]


def load_targets(spark: SparkSession, rows=None) -> DataFrame:
    """A2: allowlist of inspected hosts with default port and tls."""
    df = spark.createDataFrame(rows or TARGETS, "host STRING, port INT, tls BOOLEAN")
    return df.select("host", F.coalesce("port", F.lit(DEFAULT_PORT)).alias("port"),
                     F.coalesce("tls", F.lit(DEFAULT_TLS)).alias("tls"))


def load_policies(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or POLICIES, "p_role STRING, pattern STRING, p_method STRING")


def bare_host(host: Column) -> Column:
    return F.split_part(host, F.lit(":"), F.lit(1))


def resolve_target(log: DataFrame, targets: DataFrame, host_col: str = "host") -> DataFrame:
    """Strip the port, match the allowlist exactly; unknown hosts -> port 443, tls, not inspected."""
    t = F.broadcast(targets.select(F.col("host").alias("t_host"), F.col("port").alias("t_port"), F.col("tls").alias("t_tls")))
    j = log.withColumn("target", bare_host(F.col(host_col))).join(t, F.col("target") == F.col("t_host"), "left")
    return j.select(*log.columns, "target",
                    F.coalesce("t_port", F.lit(DEFAULT_PORT)).alias("target_port"),
                    F.coalesce("t_tls", F.lit(DEFAULT_TLS)).alias("target_tls"),
                    F.col("t_host").isNotNull().alias("inspected"))


def is_loopback(host: Column) -> Column:
    return F.lower(bare_host(host)).isin(LOOPBACK)


def drop_loopback(log: DataFrame, host_col: str = "host") -> DataFrame:
    """Loopback hosts are never proxied."""
    return log.where(~is_loopback(F.col(host_col)))


def split_inspected(msgs: DataFrame, body_col: str = "body", max_body_bytes: int | None = MAX_BODY_BYTES) -> DataFrame:
    """Flags used to route a message: inspected target, streaming request, and ``rejected``: an
    inspected body over ``max_body_bytes`` (10 MB; None: no limit) is refused, never passed on unscanned;
    all others are scanned."""
    over = F.lit(False) if max_body_bytes is None else F.coalesce(F.octet_length(body_col) > max_body_bytes, F.lit(False))
    return msgs.withColumn("rejected", F.col("inspected") & over) \
        .withColumn("streaming", F.col(body_col).contains(STREAM_MARKER)) \
        .withColumn("scan", F.col("inspected") & ~F.col("rejected"))


def key_match(pattern: Column, path: Column) -> Column:
    prefix = F.regexp_extract(pattern, "^(.*)/\\*$", 1)
    return (pattern == "*") | ((F.endswith(pattern, F.lit("/*"))) & ((path == prefix) | F.startswith(path, F.concat(prefix, F.lit("/"))))) \
        | (~F.endswith(pattern, F.lit("/*")) & (pattern == path))


def enforce_policies(requests: DataFrame, users: DataFrame, policies: DataFrame) -> DataFrame:
    """I4: ``allowed`` = some policy has the user's role (default ``user``), a matching path pattern
    and the same method or ``*``. The policies of a role are one array, joined by role and tested
    in the row: the log is read once."""
    roles = users.select(F.col("id").alias("user_id"), F.col("role").alias("_role"))
    r = requests.join(roles, "user_id", "left").withColumn("_role", F.coalesce("_role", F.lit(DEFAULT_ROLE)))
    by_role = policies.groupBy("p_role").agg(F.collect_set(F.struct("pattern", "p_method")).alias("_policies"))
    j = r.join(by_role, F.col("_role") == F.col("p_role"), "left")
    hit = F.exists("_policies", lambda p: key_match(p["pattern"], F.col("path")) & ((p["p_method"] == "*") | (p["p_method"] == F.col("method"))))
    return j.withColumn("allowed", F.coalesce(hit, F.lit(False))).drop("p_role", "_policies").withColumnRenamed("_role", "role")


def drop_revoked(requests: DataFrame, revoked: DataFrame) -> DataFrame:
    """Refuse revoked users."""
    return requests.join(revoked.select(F.col("id").alias("user_id")), "user_id", "left_anti")


def only_active(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Unknown or disabled users are denied."""
    active = users.where(F.col("status") == "active").select(F.col("id").alias("user_id"))
    return requests.join(active, "user_id", "left_semi")


def _glob_to_regex(g: str) -> str:
    return "^" + g.replace(".", "\\.").replace("*", ".*") + "$"


def in_private_172(host: Column) -> Column:
    parts = F.split(host, "\\.")
    ipv4 = host.rlike("^[0-9]{1,3}(\\.[0-9]{1,3}){3}$")
    second = F.try_element_at(parts, F.lit(2)).try_cast("int")
    return ipv4 & (F.try_element_at(parts, F.lit(1)) == "172") & (second >= 16) & (second <= 31)


def route_class(log: DataFrame, targets: DataFrame, host_col: str = "host") -> DataFrame:
    """DIRECT for plain/local/private hosts, PROXY for subdomains of a target (``*.host``), else DIRECT."""
    h = bare_host(F.col(host_col))
    direct = (~h.contains(".")) | in_private_172(h)
    for g in DIRECT_GLOBS:
        direct = direct | h.rlike(_glob_to_regex(g))
    # every proper suffix of the host at a dot, against the targets by equality. Hosts, not requests,
    # are exploded: a distinct host is looked up once
    hosts = log.select(h.alias("_h")).distinct()
    labels = F.split("_h", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.call_function("substring_index", F.col("_h"), F.lit("."), -i))
    subs = hosts.where(F.size(labels) > 1).select("_h", F.explode(suffixes).alias("_suffix"))
    proxied = subs.join(targets.select(F.col("host").alias("_suffix")), "_suffix", "left_semi").select(F.col("_h").alias("_p")).distinct()
    j = log.withColumn("_h", h).withColumn("_direct", direct).join(proxied, F.col("_h") == F.col("_p"), "left")
    return j.withColumn("route", F.when(F.col("_direct") | F.col("_p").isNull(), F.lit("DIRECT")).otherwise(F.lit("PROXY"))) \
        .drop("_h", "_direct", "_p")
