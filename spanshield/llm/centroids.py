"""Centroid clustering with a Walsh-Hadamard progressive search.

Vectors and centroids are integers. Their Walsh-Hadamard transform is exact in integers too and
keeps distances but for the factor 64, and its coefficients are read from coarse to fine: by the
number of sign changes of their basis. Squared coefficient differences add up to a lower bound that
only grows, so a centroid whose bound is strictly above the full distance of the centroid that leads
after the coarse part can be left out; ties never are. What is left is finished over all 64.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

DIMENSIONS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
STAGES = (0, 4, 8, 16, 32, 64)
WIDE = 1 << 24  # beyond it sums of squared coefficients may leave 64 bits: Python integers then
LARGEST = 1 << 52
ROWS = 4096


def _sign_changes() -> np.ndarray:
    h = np.ones((1, 1), dtype=np.int64)
    while len(h) < DIMENSIONS:
        h = np.block([[h, h], [h, -h]])
    return np.argsort((h[:, 1:] != h[:, :-1]).sum(axis=1), kind="stable")


COARSE_TO_FINE = _sign_changes()


def transform(vectors: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard coefficients of each row, coarse to fine; additions and subtractions only."""
    out = vectors.copy()
    width = 1
    while width < DIMENSIONS:
        pairs = out.reshape(len(out), -1, 2, width)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), DIMENSIONS)
        width *= 2
    return out[:, COARSE_TO_FINE]


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of integers the nearest centroid (ties: the smaller number), the squared distance,
    and how many coefficient differences were read."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) >= WIDE:
        vectors, centroids = vectors.astype(object), centroids.astype(object)
    x, c = transform(vectors), transform(centroids)
    n, k = len(x), len(c)
    rows, cols = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    bound, read = np.zeros((n, k), dtype=x.dtype), 0
    for begin, end in zip(STAGES, STAGES[1:]):
        d = x[rows, begin:end] - c[cols, begin:end]
        bound[rows, cols] += (d * d).sum(axis=1)
        read += len(rows) * (end - begin)
        if begin == 0:  # the leader of the coarse part, finished at once, is the bar for the others
            leader = bound.argmin(axis=1)
            d = x - c[leader]
            bar = (d * d).sum(axis=1)
            read += d.size
        alive = bound[rows, cols] <= bar[rows]
        if end < DIMENSIONS:
            bound[rows[~alive], cols[~alive]] = -1  # out; -1 stands for no distance
            rows, cols = rows[alive], cols[alive]
    # what was left out lies strictly above the bar, and some finished centroid is at it or below
    full = np.where(bound < 0, bar[:, None] + 1, bound)
    at = full.argmin(axis=1)
    return at, full[np.arange(n), at] // DIMENSIONS, read


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors with exactly 64 components, none null or non-finite, each component
    x as floor(64 * x). Components beyond 2^52 are an error: no long could hold their distances."""
    x = F.transform(F.col(vector_col), lambda a: a.cast("double"))
    whole = F.size(vector_col) == DIMENSIONS
    finite = F.forall(F.col("x"), lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float("inf"))))
    kept = vectors.where(whole).select(F.col(id_col).alias("vec_id"), x.alias("x")).where(F.coalesce(finite, F.lit(False)))
    scaled = F.transform("x", lambda a: F.floor(F.when(F.abs(a) * SCALE < LARGEST, a * SCALE).otherwise(
        F.raise_error(F.lit("a component is too large for exact distances")).cast("double"))))
    return kept.select("vec_id", scaled.alias("v"))


def seeds(vectors: DataFrame, k: int = CENTROIDS, seed: str = "1") -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:vec_id`` (a null id: nothing after the
    colon; repeated ids by their components), in the order of the hash."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.orderBy(key, "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in first], dtype=np.int64).reshape(-1, DIMENSIONS)


def _blocks(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            yield part, part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS).astype(np.int64)


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every row of ``vectors``."""
    def run(batches):
        for part, v in _blocks(batches):
            cluster, distance, _ = nearest(v, centroids)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance.tolist(), pa.int64())],
                                             names=["vec_id", "cluster", "distance"])

    id_type = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {id_type}, cluster int, distance long")


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, i, total, n): the sum of component ``i`` over a cluster's vectors and their number.
    Each task adds up its own rows first, in blocks whose sums stay in 64 bits."""
    def run(batches):
        for _part, v in _blocks(batches):
            cluster, _, _ = nearest(v, centroids)
            present = np.unique(cluster)
            sums = np.stack([v[cluster == c].sum(axis=0) for c in present])
            n = np.array([(cluster == c).sum() for c in present])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(present, DIMENSIONS).astype(np.int32)), pa.array(np.tile(np.arange(DIMENSIONS, dtype=np.int32), len(present))),
                 pa.array(sums.ravel()), pa.array(np.repeat(n, DIMENSIONS).astype(np.int64))], names=["cluster", "i", "total", "n"])

    partial = vectors.mapInArrow(run, "cluster int, i int, total long, n long")
    return partial.groupBy("cluster", "i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS,
            rounds: int = ROUNDS, seed: str = "1") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Each of ``rounds`` rounds assigns every vector to the nearest centroid and replaces every
    non-empty centroid by the exact componentwise floor of its vectors' mean; then vectors are
    assigned once more. Vectors that are null, of another length, or hold a null or non-finite
    component take no part. Repeated rows count each; ties go to the smaller number; fewer than
    ``k`` vectors make fewer centroids; an empty table gives no rows; extra columns are not read.
    """
    spark = vectors.sparkSession
    kept = materialize(integer_vectors(vectors, id_col, vector_col), "cluster-vectors")
    centroids = seeds(kept, k, seed)
    if len(centroids) == 0:
        return kept.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    for _ in range(rounds):
        for r in cluster_sums(kept, centroids).collect():  # at most k * 64 rows
            centroids[r["cluster"], r["i"]] = int(r["total"]) // r["n"]
    found = materialize(assign(kept, centroids), "cluster-found")
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # at most k rows
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(c, s, sum(inertia.values()), digest[c]) for c, s in inertia.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(  # at most k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

