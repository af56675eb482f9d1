"""The vault as a persistent table (A5, D2): bucketed base, append-only log, merge on read.

Each scope (global by core, sessions by core and session key) is a bucketed, sorted base table and a
log table bucketed alike. An upsert appends entries to the log, a read appends the cores it touched
(rows without a value), so either shuffles only its own rows. Reading merges base and log by key:
both sides have the buckets' partitioning, so nothing is shuffled. ``compact`` folds the log into a
new base, leaves expired entries out, and then points the vault at it; a job that fails before that
leaves the vault as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanshield.operators.vault import TTL_SECONDS, VAULT_COLS, expire_vault

SCOPES = {"global": ["core"], "session": ["core", "session_key"]}
BUCKETS = 64


class VaultTables:
    """Tables ``<name>_<scope>_<base or log>_v<n>`` of the session's catalog; the view
    ``<name>_current`` holds the version that counts."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = BUCKETS):
        self.spark, self.name, self.buckets = spark, name, buckets

    def version(self) -> int:
        return self.spark.table(f"{self.name}_current").first()["version"]

    def _table(self, scope: str, kind: str, version: int | None = None) -> str:
        return f"{self.name}_{scope}_{kind}_v{self.version() if version is None else version}"

    def _scoped(self, entries: DataFrame, scope: str) -> DataFrame:
        own = F.col("session_key").isNull() if scope == "global" else F.col("session_key").isNotNull()
        return entries.where(own).select(*SCOPES[scope], "value", "stored_at", "last_access")

    def _append(self, rows: DataFrame, scope: str, table: str) -> None:
        keys = SCOPES[scope]
        (rows.repartition(self.buckets, *keys).write.bucketBy(self.buckets, *keys).sortBy(*keys)
         .format("parquet").mode("append").saveAsTable(table))

    def _start(self, version: int, scopes: dict[str, DataFrame]) -> None:
        for scope, rows in scopes.items():
            for kind, own in (("base", rows), ("log", rows.limit(0))):
                table = self._table(scope, kind, version)
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")  # what a failed job may have left
                self._append(own, scope, table)
        # the swap: one statement of the catalog
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.name}_current AS SELECT {version} AS version")

    def create(self, vault: DataFrame) -> None:
        """A new vault from ``vault`` (``VAULT_COLS``, a key once)."""
        self._start(0, {s: self._scoped(vault, s) for s in SCOPES})

    def upsert(self, updates: DataFrame) -> None:
        """Entries are added; of one key the last write wins (by time, then value)."""
        for scope in SCOPES:
            self._append(self._scoped(updates.select(*VAULT_COLS), scope), scope, self._table(scope, "log"))

    def touch(self, reads: DataFrame) -> None:
        """``reads`` (core, session_key or null, at): entries that were read; see ``touched``."""
        seen = reads.groupBy("core", "session_key").agg(F.max("at").alias("last_access"))
        seen = seen.withColumns({"value": F.lit(None).cast("string"), "stored_at": F.lit(None).cast("timestamp")})
        for scope in SCOPES:
            self._append(self._scoped(seen, scope), scope, self._table(scope, "log"))

    def scope(self, scope: str) -> DataFrame:
        """One scope's entries, base and log merged; neither is shuffled. A base has a key once, the log
        is aggregated within its buckets first. (A join, not a union: Spark 4.1 takes a union of bucketed
        scans for bucketed but puts their partitions side by side.)"""
        keys = SCOPES[scope]
        order = F.when(F.col("value").isNotNull(), F.struct("stored_at", "value"))
        log = self.spark.table(self._table(scope, "log")).groupBy(*keys).agg(
            F.max_by("value", order).alias("l_value"), F.max("stored_at").alias("l_stored_at"), F.max("last_access").alias("l_last_access"))
        both = self.spark.table(self._table(scope, "base")).join(log, keys, "full_outer")
        newer = F.col("value").isNull() | (F.struct("l_stored_at", "l_value") > F.struct("stored_at", "value"))
        merged = both.select(*keys, F.when(F.col("l_value").isNotNull() & newer, F.col("l_value")).otherwise(F.col("value")).alias("value"),
                             F.greatest("stored_at", "l_stored_at").alias("stored_at"), F.greatest("last_access", "l_last_access").alias("last_access"))
        return merged.where(F.col("value").isNotNull())

    def scopes(self) -> tuple[DataFrame, DataFrame]:
        """(global, session) entries, as ``detokenize`` takes them."""
        return self.scope("global"), self.scope("session")

    def read(self) -> DataFrame:
        """All entries, ``VAULT_COLS``."""
        glob, sess = self.scopes()
        return glob.withColumn("session_key", F.lit(None).cast("string")).select(*VAULT_COLS).unionByName(sess.select(*VAULT_COLS))

    def compact(self, now: Column | None = None, ttl_seconds: int = TTL_SECONDS, hash_ttl: bool = False) -> None:
        """Fold the log into a new base; with ``now``, entries neither written nor read within the TTL
        are left out (``hash_ttl``: by their scope's newest access). The old version is dropped last."""
        old = self.version()
        entries = self.read() if now is None else expire_vault(self.read(), now, ttl_seconds, hash_ttl)
        self._start(old + 1, {s: self._scoped(entries, s) for s in SCOPES})
        for scope in SCOPES:
            for kind in ("base", "log"):
                self.spark.sql(f"DROP TABLE IF EXISTS {self._table(scope, kind, old)}")


def touched(tokens: DataFrame, scopes: tuple[DataFrame, DataFrame], at: str = "at") -> DataFrame:
    """(core, session_key, at) of the entries that a lookup of ``tokens`` (core, session_key, ``at``)
    reads: the global one where there is one, else the session's."""
    asked = tokens.groupBy("core", "session_key").agg(F.max(at).alias("at"))
    glob, sess = scopes
    in_global = asked.join(glob.select("core"), "core", "left_semi").groupBy("core").agg(F.max("at").alias("at"))
    in_session = asked.join(glob.select("core"), "core", "left_anti").join(sess.select("core", "session_key"), ["core", "session_key"], "left_semi")
    return in_global.select("core", F.lit(None).cast("string").alias("session_key"), "at").unionByName(
        in_session.select("core", "session_key", "at"))
