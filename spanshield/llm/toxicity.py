"""Toxicity by compression distance.

Three zstandard dictionaries are trained on labelled text: one on ordinary text, one on toxic text,
and one on what marks toxic text, words that toxic rows of the sample use far more often than
ordinary ones, near copies counted once. A text is read in short overlapping windows; each is
compressed with the ordinary dictionary alone, with the toxic one added, and with the marks added;
the bytes that either saves are the window's two distances. Literals are kept raw, so a window that
holds nothing of a dictionary has distance zero but for chance matches. The largest distances and
their sums go through a logistic curve whose 0.7 is calibrated on rows that trained no dictionary.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize

SAMPLE_TOXIC = 3_000       # bounds of the labelled sample: rows of either kind
SAMPLE_ORDINARY = 4_000
CHUNKS = 30_000            # pieces of text that train a dictionary
CHUNK_BYTES = 1024
MARK_BYTES = 4096
TOXIC_BYTES = 32768
ORDINARY_BYTES = 32768
WINDOW = 160
OVERLAP = 24
MIN_MATCH = 6      # a word of four letters and the blanks around it
THRESHOLD = 0.7
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def normalized(text: bytes) -> bytes:
    """A-Z lower-cased, every run of white space one blank, a blank at either end."""
    return b" " + _SPACE.sub(b" ", text.translate(_LOWER)).strip(b" ") + b" "


def _shingles(words: list[bytes]) -> set[int]:
    """Hashes of a text's three-word shingles (of all its words if there are fewer)."""
    parts = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    return {xxhash.xxh64_intdigest(p) - (1 << 63) for p in parts}


def _chunks(words: list[bytes]) -> list[bytes]:
    """All of a text in pieces of 40 words, and no longer than CHUNK_BYTES."""
    out = [b" " + b" ".join(words[i:i + 40]) + b" " for i in range(0, len(words), 40)]
    return [c[i:i + CHUNK_BYTES] for c in out for i in range(0, len(c), CHUNK_BYTES)]


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """Content of a dictionary trained on the samples; the samples themselves if there are too few."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Model:
    """The dictionaries' contents and the calibrated curve; ``weights`` None: nothing to learn from."""
    toxic: bytes = b""
    marks: bytes = b""
    ordinary: bytes = b""
    weights: np.ndarray | None = None

    def compressors(self):
        p = zstandard.ZstdCompressionParameters(
            window_log=18, chain_log=15, hash_log=17, search_log=1, min_match=MIN_MATCH, target_length=1,
            strategy=zstandard.STRATEGY_FAST, write_content_size=False, write_checksum=False, write_dict_id=False)
        out = []
        for content in (self.ordinary, self.ordinary + self.toxic, self.ordinary + self.marks):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            out.append(zstandard.ZstdCompressor(compression_params=p, dict_data=d))
        return out

    def score(self, distances: np.ndarray) -> float:
        if self.weights is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(features(distances) @ self.weights, -40, 40))))


def window_distances(text: bytes, ordinary, toxic, marks) -> np.ndarray:
    """Bytes that the toxic dictionary and the marks save on each window of the whole text: a row a window."""
    t = normalized(text)
    plain, bad, marked = ordinary.compress, toxic.compress, marks.compress
    out = []
    for i in range(0, max(1, len(t) - OVERLAP), WINDOW - OVERLAP):
        w = t[i:i + WINDOW]
        n = len(plain(w))
        out.append((n - len(bad(w)), n - len(marked(w))))
    return np.array(out)


def features(d: np.ndarray) -> np.ndarray:
    """Of either distance the largest three, the sum and the mean; and the number of windows."""
    out = [1.0, np.log1p(len(d)) / 4]
    for own in d.T:
        top = np.sort(np.r_[own, 0, 0, 0])[::-1]
        over = np.maximum(own - 3, 0).sum()
        out += [top[0] / 4, top[1] / 4, top[2] / 4, np.log1p(over), over / len(d)]
    return np.array(out)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + (ridge * len(y) / 100 + 1e-6) * np.eye(x.shape[1])
        w = w - np.linalg.solve(h, x.T @ (p - y) + (ridge * len(y) / 100) * w)
    return w


def fit_on(docs: DataFrame, labels: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the rows of ``docs`` that ``training`` marks and ``labels`` (doc_id, toxic) knows.
    The sample is bounded by SAMPLE_TOXIC and SAMPLE_ORDINARY ids, picked by hash; of rows that share an
    id the one with the least hash counts, rows with a null id or text do not. A quarter of either
    kind calibrates. An empty table, or one without labels of both kinds, gives a model that scores 0. Sampled texts are read whole, in tasks: the driver gets word counts, at
    most CHUNKS pieces for each dictionary, picked by hash from everywhere in the texts, and the
    features of the calibrating rows."""
    labelled = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").alias("toxic"))
    read = docs.where(F.coalesce(training, F.lit(False)) & F.col(text_col).isNotNull())
    # ids meet labels without their texts; the drawn ids, bounded, then find the texts where they lie
    known = read.select(F.col(id_col).alias("id")).distinct().join(labelled, F.col("id") == F.col("l_id"))
    known = materialize(known.select("id", (F.col("toxic") > 0).cast("int").alias("kind")), "toxicity-known")
    sizes = {r["kind"]: r["count"] for r in known.groupBy("kind").count().collect()}
    shares = [min(1.0, most / max(1, sizes.get(kind, 0))) for kind, most in ((0, SAMPLE_ORDINARY), (1, SAMPLE_TOXIC))]
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.when(F.col("kind") == 1, int(shares[1] * (1 << 30))).otherwise(int(shares[0] * (1 << 30)))
    drawn = F.broadcast(known.where(drawn).select(F.col("id").alias("d_id"), "kind"))  # about SAMPLE_TOXIC + SAMPLE_ORDINARY ids
    own = read.join(drawn, F.col(id_col) == F.col("d_id")).select("d_id", "kind", F.xxhash64("d_id", text_col).alias("h"), F.col(text_col).cast("binary").alias("text"))
    # of rows that share an id, one
    sample = own.groupBy("d_id", "kind").agg(F.min(F.struct("h", "text")).alias("r")).select("kind", "r.h", "r.text")
    sample = materialize(sample, "toxicity-sample")
    places = [(r["kind"], r["h"]) for r in sample.select("kind", "h").collect()]
    hashes = [sorted(h for k, h in places if k == kind) for kind in (0, 1)]
    if min(map(len, hashes)) < 4:
        return Model()
    cuts = [h[len(h) * 3 // 4] for h in hashes]
    held = F.col("h") >= F.when(F.col("kind") == 1, cuts[1]).otherwise(cuts[0])
    n_other = sum(h < cuts[0] for h in hashes[0])

    # toxic rows without those that mostly repeat other rows' shingles
    def shingled(batches):
        for b in batches:
            for t, h in zip(b.column("text"), b.column("h").to_numpy()):
                own = np.array(list(_shingles(normalized(t.as_py()).split())), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), h)), pa.array(own)], names=["h", "s"])

    pieces = sample.where(~held & (F.col("kind") == 1)).select("h", "text").mapInArrow(shingled, "h long, s long").distinct()
    total = {r["h"]: r["count"] for r in pieces.groupBy("h").count().collect()}
    first = {r["h"]: r["count"] for r in pieces.groupBy("s").agg(F.min("h").alias("h")).groupBy("h").count().collect()}
    novel = {h for h, n in total.items() if first.get(h, 0) >= 0.7 * n}
    if not novel:
        return Model()

    def worded(batches):
        for b in batches:
            for t, h, kind in zip(b.column("text"), b.column("h").to_pylist(), b.column("kind").to_pylist()):
                if not kind or h in novel:
                    own = list(set(normalized(t.as_py()).split()))
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(np.full(len(own), kind, np.int32))], names=["word", "kind"])

    once = sample.where(~held).dropDuplicates(["kind", "h"])
    counted = once.mapInArrow(worded, "word binary, kind int").groupBy("word").agg(F.sum("kind").alias("bad"), F.sum(1 - F.col("kind")).alias("good"))
    least = max(3, 0.01 * len(novel))
    marks = {bytes(r["word"]) for r in counted.where(F.col("bad") >= least).collect() if r["bad"] / len(novel) >= 20 * (r["good"] + 0.5) / n_other}

    def cut(batches):
        for b in batches:
            for t, h, kind in zip(b.column("text"), b.column("h").to_pylist(), b.column("kind").to_pylist()):
                words = normalized(t.as_py()).split()
                own = [(kind, c) for c in _chunks(words)]
                if kind and h in novel:
                    own += [(2, c) for c in _chunks([w for w in words if w in marks])]
                if own:
                    part, chunk = zip(*own)
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(chunk, pa.binary()), pa.array(np.full(len(own), h)),
                                                      pa.array(np.arange(len(own)))], names=["part", "chunk", "h", "nth"])

    chunks = once.mapInArrow(cut, "part int, chunk binary, h long, nth long").withColumn("key", F.xxhash64("h", "nth"))
    # a toxic piece counts once; marks and ordinary pieces as often as they come
    alone = F.when(F.col("part") != 1, F.col("key"))
    chunks = materialize(chunks.groupBy("part", "chunk", alone.alias("alone")).agg(F.min("key").alias("key")).drop("alone"), "toxicity-chunks")
    n_chunks = {r["part"]: r["count"] for r in chunks.groupBy("part").count().collect()}
    if not n_chunks.get(0):
        return Model()

    def drawn_chunks(part):
        share = min(1.0, CHUNKS / max(1, n_chunks.get(part, 0)))
        rows = chunks.where((F.col("part") == part) & (F.pmod("key", F.lit(1 << 30)) < int(share * (1 << 30)))).select("key", "chunk").collect()
        return [bytes(r["chunk"]) for r in sorted(rows, key=lambda r: (r["key"], bytes(r["chunk"])))]

    if not n_chunks.get(1):
        return Model()
    model = Model(_dictionary(TOXIC_BYTES, drawn_chunks(1)), _dictionary(MARK_BYTES, drawn_chunks(2)), _dictionary(ORDINARY_BYTES, drawn_chunks(0)))

    def measured(batches):
        pair = model.compressors()
        for b in batches:
            x = [features(window_distances(t.as_py(), *pair)).tolist() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("h"), pa.array(x, pa.list_(pa.float64()))], names=["kind", "h", "x"])

    rows = sample.where(held).mapInArrow(measured, "kind int, h long, x array<double>").collect()
    rows = sorted(rows, key=lambda r: (-r["kind"], r["h"]))
    return calibrate(model, np.array([r["x"] for r in rows]), np.array([r["kind"] for r in rows], float), shares[1] / shares[0])


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, stands_for: float = 1.0) -> Model:
    """``model`` with the curve of held rows' features. An ordinary text of the sample stands for so
    many times the rows that a toxic one stands for."""
    w = _logistic(x, y)
    # shift the curve so that THRESHOLD sits where the held rows are told apart best
    z = x @ w
    order = np.argsort(-z, kind="stable")
    hits, wrong = np.cumsum(y[order]), np.cumsum(1 - y[order]) * stands_for
    f1 = 2 * hits / (hits + wrong + y.sum())
    best = int(np.argmax(f1))
    at = z[order[best]]
    after = z[order[best + 1]] if best + 1 < len(z) else at - 1
    w[0] += np.log(THRESHOLD / (1 - THRESHOLD)) - (at + after) / 2
    model.weights = w
    return model


def toxicity(docs: DataFrame, model: Model, *, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) added in place of the text, or beside it with ``keep_text``.

    Whole texts are read. Null and empty texts have one blank window and a score like any other;
    a model that had nothing to learn from scores 0. Other columns pass through; a column named
    score is replaced. Repeated rows score alike; an empty table gives no rows.
    """
    names = [c for c in docs.columns if c != "score" and (keep_text or c != text_col)]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("score", T.DoubleType())])
    docs = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, text_col])])

    def run(batches):
        m = model
        pair = m.compressors() if m.weights is not None else None
        for b in batches:
            texts = b.column(text_col).cast(pa.large_binary())
            scores = [m.score(window_distances(t.as_py() or b"", *pair)) if pair else 0.0 for t in texts]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(scores, pa.float64())], names=[*names, "score"])

    return docs.mapInArrow(run, schema)
