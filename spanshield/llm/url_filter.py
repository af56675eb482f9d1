"""URL filters by Bloom filter cascades.

A cascade answers "is this key listed?" exactly for every key of the corpus. Level 0 encodes the
listed keys, level 1 the corpus keys that level 0 takes for listed though they are not, level 2 the
listed keys that level 1 takes for those, and so on until a level makes no mistake; the first level
that says no decides. A url is judged by bit tests alone: the filters ride in the plan as literals
while they are small, and past that bound as shards that meet the keys by shard number.
DataFrame operations only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lower_ascii, materialize

MIN_BITS = 1024
LITERAL_BYTES = 1 << 20
SHARD_BYTES = 4096  # of a filter past LITERAL_BYTES: what a key's row meets and reads


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: the host follows the first ``://`` up to ``/ ? #`` or the end, A-Z
    lower-cased; the path runs on up to ``? #`` or the end. Both are empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(url.isNull() | (at == 0), F.lit("")).otherwise(F.substring(url, at + 3, F.length(url)))
    return (lower_ascii(F.regexp_extract(rest, "^([^/?#]*)", 1)),
            F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


@dataclass
class Level:
    bits: int
    hashes: int
    shards: int
    literal: bytes | None = None     # one shard: the filter itself
    table: DataFrame | None = None   # several: (shard, words binary)


@dataclass
class Cascade:
    """Exact membership of any key of the universe that the cascade was built over."""
    levels: list[Level] = field(default_factory=list)

    def contains(self, key: Column, hits: list[Column] | None = None) -> Column:
        """Whether ``key`` is listed; ``hits``: the levels' tests where they are known already."""
        if not self.levels:
            return F.lit(False)
        answer = F.lit((len(self.levels) - 1) % 2 == 0)
        for i in reversed(range(len(self.levels))):
            hit = hits[i] if hits else _test(key, i, self.levels[i], F.lit(self.levels[i].literal))
            answer = F.when(hit, answer).otherwise(F.lit(i % 2 == 1))
        return answer


def _shard(key: Column, level: int, lv: Level) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1 - level), key), F.lit(lv.shards)).cast("int")


def _positions(key: Column, level: int, lv: Level) -> list[Column]:
    one, two = F.xxhash64(F.lit(2 * level), key), F.xxhash64(F.lit(2 * level + 1), key)
    # 31-bit halves: their combinations never overflow a long
    a, b = F.shiftrightunsigned(one, 33), F.shiftrightunsigned(two, 33)
    return [F.pmod(a + F.lit(i) * b + F.lit(i * i), F.lit(lv.bits)).cast("int") for i in range(lv.hashes)]


def _test(key: Column, level: int, lv: Level, bits: Column) -> Column:
    out = F.lit(True)
    for p in _positions(key, level, lv):
        byte = F.conv(F.hex(F.substring(bits, F.shiftright(p, 3) + 1, F.lit(1))), 16, 10).cast("int")
        out = out & (F.shiftright(byte, 0).bitwiseAND(F.element_at(F.array(*[F.lit(1 << j) for j in range(8)]), p % 8 + 1)) != 0)
    return out


def _encode(keys: DataFrame, n: int, p: float, level: int, literal_bytes: int) -> Level:
    hashes = max(1, min(20, round(math.log2(1 / p))))
    total = max(MIN_BITS, math.ceil(n * math.log2(1 / p) / math.log(2)))
    shards = 1 if total <= 8 * literal_bytes else math.ceil(total / 8 / min(literal_bytes, SHARD_BYTES))
    lv = Level(bits=8 * math.ceil(total / shards / 8), hashes=hashes, shards=shards)
    pos = keys.select(_shard(F.col("key"), level, lv).alias("shard"), F.explode(F.array(*_positions(F.col("key"), level, lv))).alias("p"))
    octets = pos.groupBy("shard", F.shiftright("p", 3).alias("at")).agg(
        F.bit_or(F.element_at(F.array(*[F.lit(1 << j) for j in range(8)]), F.col("p") % 8 + 1)).alias("octet"))
    if shards == 1:  # at most bits / 8 rows, and that is at most literal_bytes
        raw = bytearray(lv.bits // 8)
        for r in octets.collect():
            raw[r["at"]] = r["octet"]
        lv.literal = bytes(raw)
        return lv
    # a row for every byte of a shard that holds anything, put together in order
    blank = octets.select("shard").distinct().select("shard", F.explode(F.sequence(F.lit(0), F.lit(lv.bits // 8 - 1))).alias("at"),
                                                     F.lit(0).cast("tinyint").alias("octet"))
    every = octets.select("shard", "at", F.col("octet").cast("int").alias("octet")).unionByName(blank.withColumn("octet", F.col("octet").cast("int")))
    every = every.groupBy("shard", "at").agg(F.max("octet").alias("octet"))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "octet"))), lambda x: F.lpad(F.hex(x["octet"]), 2, "0")), "")
    lv.table = materialize(every.groupBy("shard").agg(F.unhex(words).alias("words")), "url-shards")
    return lv


def build_cascade(universe: DataFrame, listed: DataFrame, literal_bytes: int = LITERAL_BYTES) -> Cascade:
    """A cascade over ``universe`` (every key of the corpus, repeats allowed) that holds exactly the
    keys of ``listed``; both have one column ``key``. Nulls are left out. An empty list gives a
    cascade that holds nothing."""
    listed = materialize(listed.where("key is not null").select("key").distinct(), "url-listed")
    n = listed.count()
    cascade = Cascade()
    if n == 0:
        return cascade
    universe = universe.where("key is not null").select("key")
    others = max(n, universe.agg(F.approx_count_distinct("key")).first()[0])
    # few wrong answers at level 0 as against the list: the levels after it stay as small as the list
    lv = _encode(listed, n, min(0.5, max(2.0 ** -20, 0.7 * n / others)), 0, literal_bytes)
    cascade.levels.append(lv)
    encoded, against = listed, None
    while True:
        i = len(cascade.levels) - 1
        lv = cascade.levels[i]
        tested = universe if i == 0 else against
        wrong = _where_positive(tested, i, lv).distinct()
        if i == 0:
            wrong = wrong.join(listed, "key", "left_anti")
        wrong = materialize(wrong, f"url-level{i + 1}")
        m = wrong.count()
        if m == 0:
            return cascade
        against, encoded = encoded, wrong
        cascade.levels.append(_encode(encoded, m, 0.5 if i else 0.25, i + 1, literal_bytes))


def _where_positive(keys: DataFrame, level: int, lv: Level) -> DataFrame:
    if lv.literal is not None:
        return keys.where(_test(F.col("key"), level, lv, F.lit(lv.literal)))
    met = keys.withColumn("shard", _shard(F.col("key"), level, lv)).join(lv.table, "shard")
    return met.where(_test(F.col("key"), level, lv, F.col("words"))).select("key")


def rule_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Array of (length, host length, key) of every rule that could fit: a suffix of the host with
    as many labels as some rule has, and a beginning of the path as long as some rule's."""
    out = []
    for n in labels:
        suffix = F.substring_index(host, ".", -n)
        for m in lengths:
            key = F.concat(suffix, F.substring(path, 1, m))
            out.append(F.when((F.length(path) >= m) & (host != ""), F.struct(
                F.length(key).alias("len"), F.length(suffix).alias("host_len"), key.alias("key"))))
    return F.array_distinct(F.filter(F.array(*out), lambda c: c.isNotNull()))


def judge_urls(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", id_col: str = "page_id",
               default: str = "allow", literal_bytes: int = LITERAL_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    ``rules`` has host, path, verdict ("block" or "allow"). A rule fits its host and all its
    subdomains if the path starts with the rule's; the longest rule (then the longest host) wins,
    an allow rule before an equal block rule. ``verdict`` is the rule's, or ``default`` when no key
    of the url is listed. Null urls and urls without ``://`` have empty host and path and fit no
    rule. Repeated rows are judged alike; an empty table gives no rows. Extra columns are ignored.
    """
    keyed = rules.select(F.concat("host", "path").alias("key"), "verdict",
                         F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("len")).where("key is not null")
    shape = keyed.agg(F.collect_set("labels").alias("labels"), F.collect_set("len").alias("lens")).first()
    labels, lens = sorted(shape["labels"]), sorted(shape["lens"])
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not labels:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    cands = rule_keys(F.col("host"), F.col("path"), labels, lens)
    universe = urls.select(F.explode(cands).alias("c")).select("c.key")
    block = build_cascade(universe, keyed.where("verdict = 'block'"), literal_bytes)
    allow = build_cascade(universe, keyed.where("verdict = 'allow'"), literal_bytes)
    if all(lv.literal is not None for c in (block, allow) for lv in c.levels):
        best = F.array_max(F.filter(F.transform(cands, lambda c: F.struct(
            c["len"].alias("len"), c["host_len"].alias("host_len"), allow.contains(c["key"]).alias("allow"),
            block.contains(c["key"]).alias("block"), c["key"].alias("key"))), lambda c: c["allow"] | c["block"]))
        judged = urls.withColumn("best", best)
    else:
        judged = _judge_sharded(urls, cands, allow, block)
    return judged.select("page_id", "host", "path", F.col("best.key").alias("rule"),
                         F.when(F.col("best").isNull(), F.lit(default))
                         .when(F.col("best.allow"), F.lit("allow")).otherwise(F.lit("block")).alias("verdict"))


def _judge_sharded(urls: DataFrame, cands: Column, allow: Cascade, block: Cascade) -> DataFrame:
    """The same for filters past the literal bound: each distinct (host, path) is judged once, its
    keys meet the filters by shard number."""
    keys = urls.select("host", "path").distinct().select("host", "path", F.explode(cands).alias("c"))
    distinct = keys.select(F.col("c.key").alias("key")).distinct()
    for name, cascade in (("allow", allow), ("block", block)):
        hits = []
        for i, lv in enumerate(cascade.levels):
            hits.append(F.col(f"{name}_{i}"))
            if lv.literal is not None:
                distinct = distinct.withColumn(f"{name}_{i}", _test(F.col("key"), i, lv, F.lit(lv.literal)))
            else:  # the shard is read where it is met; only the answer goes on
                met = distinct.withColumn("shard", _shard(F.col("key"), i, lv)).join(lv.table, "shard", "left")
                test = F.coalesce(_test(F.col("key"), i, lv, F.col("words")), F.lit(False))
                distinct = met.withColumn(f"{name}_{i}", test).drop("shard", "words")
        distinct = distinct.withColumn(name, cascade.contains(F.col("key"), hits)).drop(*[f"{name}_{i}" for i in range(len(hits))])
    listed = distinct.where("allow or block")
    best = (keys.withColumn("key", F.col("c.key")).join(listed, "key")
            .groupBy("host", "path").agg(F.max(F.struct(F.col("c.len").alias("len"), F.col("c.host_len").alias("host_len"), "allow", "block", "key")).alias("best")))
    return urls.join(best, ["host", "path"], "left")


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows as a table."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")
