"""Approximate nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample turns vectors into 64-bit codes. A code is split into
substrings and each substring is an index key. By the pigeonhole principle two codes within Hamming
radius r = m*s + a agree to s bits in one of the first a + 1 substrings or to s - 1 bits in one of
the others, so probing those keys retrieves every code within the radius; the floats then rerank.

Equal vectors are one point. The points of a key are cut into blocks of bounded size, probes go to
every block, and a task hands on only the best of what it has seen for each query. Queries that
find fewer than k points within the radius are answered by an exact scan in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize

SUBSTRINGS = 8
WIDTH = 64 // SUBSTRINGS
SAMPLE = 10_000
SAMPLE_QUERIES = 256
BLOCK = 4096
SCAN_QUERIES = 1024
SCAN_POINTS = 65_536
FLUSH = 400_000


@dataclass
class Coder:
    """Learned codes: sign((x - mean) @ rotation), and the radius that they need."""
    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        bits = (x - self.mean) @ self.rotation > 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def learn(sample: np.ndarray, k: int, coverage: float = 0.99, rounds: int = 30, seed: int = 7) -> Coder:
    """Iterative quantization on the sample's principal axes (dimensions under 64 get several
    rotations side by side). The radius covers ``coverage`` of the sample's own k nearest; over the
    whole table neighbours are closer, so it errs on the wide side."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    mean = sample.mean(axis=0)
    x = sample - mean
    _, _, axes = np.linalg.svd(x[:4096], full_matrices=True)
    parts, left = [], 64
    while left > 0:
        n = min(d, left)
        axis = axes[:n].T
        v = x @ axis
        r = np.linalg.qr(rng.standard_normal((n, n)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ w).T
        parts.append(axis @ r)
        left -= n
    coder = Coder(mean, np.hstack(parts), 64)
    if len(sample) > 1:
        codes = coder.codes(sample)
        ask = sample[:SAMPLE_QUERIES]
        far = (ask ** 2).sum(1)[:, None] - 2 * ask @ sample.T + (sample ** 2).sum(1)[None]
        far[np.arange(len(ask)), np.arange(len(ask))] = np.inf
        n = min(k, len(sample) - 1)
        near = np.argpartition(far, n - 1, axis=1)[:, :n]
        bits = np.bitwise_count(codes[:len(ask), None] ^ codes[near])
        coder.radius = int(np.quantile(bits, coverage, method="higher"))
    return coder


def usable(vec: Column, dim: int | None = None) -> Column:
    """Whether a vector takes part: not null, all components finite, not all zero."""
    ok = vec.isNotNull() & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0)
    return F.coalesce(ok & (F.size(vec) == dim) if dim else ok, F.lit(False))


def _top(q: np.ndarray, c: np.ndarray, far: np.ndarray, k: int):
    """The k nearest of each query, ties to the smaller id."""
    order = np.lexsort((c, far, q))
    q, c, far = q[order], c[order], far[order]
    first = np.r_[True, q[1:] != q[:-1]]
    at = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    keep = at < k
    return q[keep], c[keep], far[keep]


def search(vectors: DataFrame, is_query: Column, *, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
           sample: int = SAMPLE, coverage: float = 0.99) -> DataFrame:
    """query_id, rank, vec_id, score: for every row that ``is_query`` marks its ``k`` nearest other
    rows found, by Euclidean distance in double precision, ties to the smaller id; all other rows
    if there are fewer.

    Vectors that are null, zero, of another than the most frequent length, or that hold null or
    non-finite components take no part, nor do rows with a null id. Rows repeated with the same id
    and vector count once. A table without usable vectors gives no rows.
    """
    spark = vectors.sparkSession
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec")))
    dims = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = dims["d"]
    rows = rows.where(F.size("vec") == dim).withColumn("h", F.xxhash64("vec"))

    # equal vectors are one point, named by its smallest id; k + 1 of its ids can ever be wanted
    alike = Window.partitionBy("h", "vec").orderBy("id")
    members = rows.select("h", "vec", "id").withColumn("n", F.dense_rank().over(alike)).where(F.col("n") <= k + 1)
    members = materialize(members.distinct(), "ann-members")
    points = members.where("n = 1").select(F.col("id").alias("point"), "h", "vec")
    points = materialize(points, "ann-points")
    n_points, n_members = points.count(), members.count()
    names = points.select("point", F.col("h").alias("ph"), F.col("vec").alias("pvec"))
    same = (F.col("h") == F.col("ph")) & (F.col("vec") == F.col("pvec"))
    asked = materialize(rows.where("asks").join(names, same).select("id", "point").distinct(), "ann-queries")
    members = members.join(names, same).select("point", "id")

    part = min(1.0, sample / n_points)
    drawn = points.where(F.pmod(F.xxhash64("point", F.lit("ann")), F.lit(1 << 20)) <= int(part * (1 << 20))).select("point", "vec")
    drawn = drawn.orderBy(F.xxhash64("point", F.lit("ann-order")), "point").toPandas()  # learn() takes parts of it from the front
    coder = learn(np.array(drawn["vec"].tolist()).reshape(-1, dim), k)

    def encode(batches):
        for b in batches:
            codes = coder.codes(np.array(b["vec"].tolist()).reshape(-1, dim))
            yield b.assign(code=codes.view(np.int64))

    coded = materialize(points.select("point", "vec").mapInPandas(encode, "point long, vec array<double>, code long"), "ann-codes")
    wanted = coded.join(asked.select("point").distinct(), "point")
    found = materialize(_probe(coded, wanted, coder.radius, k + 1, dim), "ann-found")

    # exact scan for queries that the radius leaves short
    per_point = found.join(members, F.col("other") == F.col("point")).groupBy("asker").count()
    short = wanted.join(per_point, F.col("point") == F.col("asker"), "left").where(
        F.coalesce("count", F.lit(0)) < min(k + 1, n_members)).select("point", "vec")
    short = materialize(short, "ann-short")
    scanned = materialize(_scan(coded, short, short.count(), n_points, k + 1, dim), "ann-scan")
    found = found.unionByName(scanned)

    nearest = Window.partitionBy("asker").orderBy("far", "other")
    best = found.distinct().withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1)
    pairs = best.join(members, F.col("other") == F.col("point")).select("asker", F.col("id").alias("vec_id"), "far")
    pairs = pairs.withColumn("n", F.row_number().over(Window.partitionBy("asker").orderBy("far", "vec_id"))).where(F.col("n") <= k + 1)
    out = asked.withColumnRenamed("id", "query_id").join(pairs, F.col("point") == F.col("asker")).where("vec_id <> query_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "point").orderBy("far", "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("far").alias("score"))


def substring_radii(radius: int) -> list[int]:
    """Bits that each substring may differ in so that no code within ``radius`` is missed."""
    s, a = divmod(radius, SUBSTRINGS)
    return [s if j <= a else s - 1 for j in range(SUBSTRINGS)]


def _probe(coded: DataFrame, wanted: DataFrame, radius: int, k: int, dim: int) -> DataFrame:
    radii = substring_radii(radius)
    subs = F.posexplode(F.array(*[F.shiftrightunsigned("code", WIDTH * j).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")
                                  for j in range(SUBSTRINGS)])).alias("sub", "key")
    index = coded.select("point", "vec", "code", subs)
    # at most SUBSTRINGS * 2**WIDTH rows
    blocks = F.broadcast(index.groupBy("sub", "key").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks")))
    index = index.join(blocks, ["sub", "key"]).select(
        "sub", "key", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("asks"), "point", "vec", "code")
    near = [[m for m in range(1 << WIDTH) if m.bit_count() <= r] for r in radii]
    masks = F.array(*[F.array(*[F.lit(m) for m in ms]).cast("array<int>") for ms in near])
    probes = (wanted.select("point", "vec", "code", subs)
              .withColumn("mask", F.explode(F.element_at(masks, F.col("sub") + 1)))
              .withColumn("key", F.col("key").bitwiseXOR(F.col("mask"))).drop("mask")
              .join(blocks, ["sub", "key"])
              .select("sub", "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("asks"), "point", "vec", "code"))
    dealt = index.unionByName(probes).repartition("sub", "key", "block").sortWithinPartitions("sub", "key", "block", "asks", "point")

    def match(batches):
        kept = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        held, size = None, 0
        points, codes, vecs = [], [], []
        for batch in batches:
            groups = batch.groupby(["sub", "key", "block", "asks"], sort=True)
            for (sub, key, block, asks), g in groups:
                x = np.array(g["vec"].tolist()).reshape(-1, dim)
                p, c = g["point"].to_numpy(), g["code"].to_numpy().view(np.uint64)
                if held != (sub, key, block):
                    held, points, codes, vecs = (sub, key, block), [], [], []
                if not asks:  # the points of a key come first; they go on in the next batch at times
                    points.append(p)
                    codes.append(c)
                    vecs.append(x)
                    continue
                if not points:
                    continue
                if len(points) > 1:
                    points, codes, vecs = [np.concatenate(points)], [np.concatenate(codes)], [np.concatenate(vecs)]
                for i in range(0, len(p), 256):
                    differ = c[i:i + 256, None] ^ codes[0][None]
                    q, o = np.nonzero(np.bitwise_count(differ) <= radius)
                    differ = differ[q, o]
                    first = np.ones(len(q), bool)  # the first substring that can find a pair hands it on
                    for j in range(sub):
                        first &= np.bitwise_count((differ >> np.uint64(WIDTH * j)) & np.uint64((1 << WIDTH) - 1)) > radii[j]
                    q, o = q[first], o[first]
                    far = np.sqrt(((x[i + q] - vecs[0][o]) ** 2).sum(axis=1))
                    kept.append(_top(p[i + q], points[0][o], far, k))
                    size += len(kept[-1][0])
                if size > FLUSH:
                    merged = _top(*map(np.concatenate, zip(*kept)), k)
                    kept, size = [merged], len(merged[0])
                    if size > FLUSH // 2:
                        yield pd.DataFrame(dict(zip(("asker", "other", "far"), merged)))
                        kept, size = kept[:0], 0
        if kept:
            yield pd.DataFrame(dict(zip(("asker", "other", "far"), _top(*map(np.concatenate, zip(*kept)), k))))

    return dealt.mapInPandas(match, "asker long, other long, far double")


def _scan(coded: DataFrame, asked: DataFrame, n_asked: int, n_points: int, k: int, dim: int) -> DataFrame:
    """Exact: the k nearest points of every query in each block of points. Queries are dealt into packs
    and points into blocks; a pack meets a block in one task, so one plan serves any number of either."""
    packs, blocks = -(-n_asked // SCAN_QUERIES), -(-n_points // SCAN_POINTS)
    if not n_asked:
        return coded.sparkSession.createDataFrame([], "asker long, other long, far double")
    pack = F.pmod(F.xxhash64("point", F.lit("pack")), F.lit(packs)).cast("int")
    block = F.pmod(F.xxhash64("point", F.lit("block")), F.lit(blocks)).cast("int")
    asks = asked.select(pack.alias("pack"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"), "point", "vec")
    points = coded.select(F.explode(F.sequence(F.lit(0), F.lit(packs - 1))).alias("pack"), block.alias("block"), F.lit(1).alias("kind"), "point", "vec")
    dealt = asks.unionByName(points).repartition("pack", "block").sortWithinPartitions("pack", "block", "kind", "point")

    def scan(batches):
        names = ("asker", "other", "far")
        held, ids, vecs, best = None, [], [], []
        for batch in batches:
            done = []
            for (p, b, kind), g in batch.groupby(["pack", "block", "kind"], sort=True):
                x, point = np.array(g["vec"].tolist()).reshape(-1, dim), g["point"].to_numpy()
                if held != (p, b):
                    done += best
                    held, ids, vecs, best = (p, b), [], [], []
                if not kind:  # the queries of a pack come first; they go on in the next batch at times
                    ids.append(point)
                    vecs.append(x)
                    continue
                asker, ask = np.concatenate([np.empty(0, np.int64), *ids]), np.vstack([np.empty((0, dim)), *vecs])
                for i in range(len(asker)):
                    far = np.sqrt(((x - ask[i]) ** 2).sum(axis=1))
                    best.append(_top(np.full(len(point), asker[i]), point, far, k))
                if best:
                    best = [_top(*map(np.concatenate, zip(*best)), k)]
            if done:
                yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*done)))))
        if best:
            yield pd.DataFrame(dict(zip(names, best[0])))

    return dealt.mapInPandas(scan, "asker long, other long, far double")
