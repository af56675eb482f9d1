"""Document fingerprints from prefix polynomial hashes.

Of a text's code points c_0, c_1, ... the prefix array holds P[i] = sum of c_j * B^j for j < i, modulo
a prime, for two bases B. P[j] - P[i], divided by B^i, is the hash of the span [i, j) wherever it
stands, so any two spans are held against each other in constant time, the longest common extension
of two positions is found by binary search, and the hash of a spliced text follows from its parts.

A fingerprint holds the length, the hash of the whole text and, for three window lengths, a sketch of
the hashes of all its windows, read off the prefix arrays: the n-th repeat of a window is an element
of its own, elements are dealt into bins, a bin keeps the least. The likeness of two fingerprints is
the share of windows that they have in common, twice the common ones over all, as estimated from the
bins of the longest windows that suit the shorter text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIME = np.uint64((1 << 31) - 1)
BASES = (1_000_003_937, 1_736_051_957)
#: (window length, bins, least text length): the first level that the shorter text reaches decides.
LEVELS = ((32, 128, 128), (8, 64, 32), (2, 32, 1))
PIECE = 1 << 18  # code points hashed at once; longer texts go piece by piece
ROWS_PER_BUCKET = 512
MAX_BUCKETS = 65_536
NULL_BUCKETS = 64
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for x < 2^62."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x == PRIME, np.uint64(0), x)


class _Powers:
    """Powers of a base and of its inverse, up to a piece and a window."""

    def __init__(self, base: int):
        self.base = base
        self.up, self.down = (self._table(b) for b in (base, pow(base, -1, int(PRIME))))

    @staticmethod
    def _table(base: int) -> np.ndarray:
        out, size = np.ones(1, dtype=np.uint64), PIECE + 64
        while len(out) < size:
            out = np.concatenate([out, _mod(out * np.uint64(pow(base, len(out), int(PRIME))))])
        return out[:size + 1]


_powers: list[_Powers] = []


def powers() -> list[_Powers]:
    """Built once in a worker."""
    if not _powers:
        _powers.extend(_Powers(b) for b in BASES)
    return _powers


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class PrefixHashes:
    """The prefix arrays of one text, a block of ``PIECE`` code points each, and the prefix hash of
    every block's start. Window hashes of a text of one block are kept for reuse."""

    def __init__(self, points: np.ndarray):
        self.points, self.n = points, len(points)
        self.blocks, self.starts, self.known = [], [], {}
        at = [0, 0]
        for begin in range(0, max(1, self.n), PIECE):
            part = points[begin:begin + PIECE].astype(np.uint64) + np.uint64(1)
            arrays = []
            for p in powers():
                sums = np.zeros(len(part) + 1, dtype=np.uint64)
                np.cumsum(_mod(part * p.up[:len(part)]), out=sums[1:])
                arrays.append(_mod(sums))
            self.starts.append(tuple(at))
            self.blocks.append(arrays)
            shift = [pow(p.base, begin, int(PRIME)) for p in powers()]
            at = [(a + s * int(x[-1])) % int(PRIME) for a, s, x in zip(at, shift, arrays)]

    def prefix(self, i: int) -> tuple[int, ...]:
        """P[i] for each base."""
        block = min(i // PIECE, len(self.blocks) - 1)
        begin = block * PIECE
        return tuple((a + pow(p.base, begin, int(PRIME)) * int(x[i - begin])) % int(PRIME)
                     for a, p, x in zip(self.starts[block], powers(), self.blocks[block]))

    def span(self, i: int, j: int) -> int:
        """The hash of code points i to j (not included), the same wherever the span stands."""
        out = 0
        for a, b, p in zip(self.prefix(i), self.prefix(j), powers()):
            out = out << 31 | (b - a) * pow(p.base, -i, int(PRIME)) % int(PRIME)
        return out

    def windows(self, k: int) -> np.ndarray:
        """``span(i, i + k)`` of every i, read off the arrays."""
        if k in self.known:
            return self.known[k]
        found = []
        for b, arrays in enumerate(self.blocks):
            size = len(arrays[0]) - 1
            inner = max(0, size - k + 1)
            out = np.zeros(inner, dtype=np.uint64)
            for p, x in zip(powers(), arrays):
                d = x[k:] + (PRIME - x[:inner]) if inner else out
                out = out << np.uint64(31) | _mod(_mod(d) * p.down[:inner])
            found.append(out)
            if b + 1 < len(self.blocks):  # windows that reach into the next block
                begin = (b + 1) * PIECE - min(k - 1, size)
                found.append(_few(self.points[begin:(b + 1) * PIECE + k - 1], k))
        if len(self.blocks) == 1:
            self.known[k] = found[0]
        return np.concatenate(found)


def _few(points: np.ndarray, k: int) -> np.ndarray:
    """Window hashes of a short run of code points."""
    n = len(points) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    at = np.lib.stride_tricks.sliding_window_view(points.astype(np.uint64) + np.uint64(1), k)
    out = np.zeros(n, dtype=np.uint64)
    for p in powers():
        out = out << np.uint64(31) | _mod(_mod(at * p.up[:k]).sum(axis=1))
    return out


def common_extension(x: PrefixHashes, i: int, y: PrefixHashes, j: int) -> int:
    """How many code points from ``i`` in ``x`` and ``j`` in ``y`` on are equal, by binary search in a
    span that doubles until it differs."""
    low, most, high = 0, min(x.n - i, y.n - j), 1
    while high <= most and x.span(i, i + high) == y.span(j, j + high):
        low, high = high, 2 * high
    high = min(high - 1, most)
    while low < high:
        middle = (low + high + 1) // 2
        if x.span(i, i + middle) == y.span(j, j + middle):
            low = middle
        else:
            high = middle - 1
    return low


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def sketch(windows: np.ndarray, bins: int) -> np.ndarray:
    """The least element of each bin (16 bits of it), 0 for an empty bin. The n-th repeat of a window
    is an element of its own."""
    least = np.full(bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    if len(windows):
        ordered = np.sort(windows)
        place = np.arange(len(ordered))
        first = np.maximum.accumulate(np.where(np.concatenate([[True], ordered[1:] != ordered[:-1]]), place, 0))
        element = _mix(ordered + (place - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        np.minimum.at(least, (element & np.uint64(bins - 1)).astype(np.int64), element >> np.uint64(8))
    kept = (least & np.uint64(0xFFFF)) | np.uint64(1)
    return np.where(least == np.iinfo(np.uint64).max, 0, kept).astype(np.uint16)


class Print:
    """A fingerprint: length, whole hash, one sketch a level."""

    def __init__(self, n: int, whole: int, sketches: list[np.ndarray]):
        self.n, self.whole, self.sketches = n, whole, sketches

    def text(self) -> str:
        return f"{self.n:x}.{self.whole:016x}." + ".".join(s.astype(">u2").tobytes().hex() for s in self.sketches)

    @classmethod
    def parse(cls, text: str) -> Print:
        n, whole, *sketches = text.split(".")
        return cls(int(n, 16), int(whole, 16), [np.frombuffer(bytes.fromhex(s), dtype=">u2") for s in sketches])


def fingerprint(hashes: PrefixHashes) -> Print:
    """The fingerprint of a text from its prefix arrays."""
    return Print(hashes.n, hashes.span(0, hashes.n), [sketch(_level(hashes, k), bins) for k, bins, _ in LEVELS])


def _level(x: PrefixHashes, k: int) -> np.ndarray:
    """All windows of a level; of a text that is shorter than a window of the last level, itself."""
    if x.n < k and k == LEVELS[-1][0] and x.n:
        return np.array([x.span(0, x.n)], dtype=np.uint64)
    return x.windows(k)


def likeness(a: Print, b: Print) -> float:
    """0 to 1: the estimated share of common windows, twice the common ones over both texts' windows.
    1 for equal texts (two empty ones, too), 0 if one alone is empty."""
    if a.n == b.n and a.whole == b.whole:
        return 1.0
    shorter = min(a.n, b.n)
    if not shorter:
        return 0.0
    level = next(i for i, (_, _, least) in enumerate(LEVELS) if shorter >= least)
    x, y = a.sketches[level], b.sketches[level]
    either = np.count_nonzero((x != 0) | (y != 0))
    same = np.count_nonzero((x == y) & (x != 0))
    return 2.0 * same / (either + same) if either else 0.0


def spliced(x: PrefixHashes, y: PrefixHashes, keep: int, take: int) -> tuple[Print, int]:
    """The fingerprint of the first ``keep`` code points of ``x`` and the first ``take`` of ``y``, and
    how far it agrees with ``x`` from the start. Windows inside either part are known from its arrays;
    only those across the seam are hashed anew, and the whole hash is put together from the prefixes."""
    whole = 0
    for a, b, p in zip(x.prefix(keep), y.prefix(take), powers()):
        whole = whole << 31 | (a + pow(p.base, keep, int(PRIME)) * b) % int(PRIME)
    n, sketches = keep + take, []
    for k, bins, _ in LEVELS:
        if n < k and k == LEVELS[-1][0] and n:
            windows = np.array([whole], dtype=np.uint64)
        else:
            across = np.concatenate([x.points[max(0, keep - k + 1):keep], y.points[:min(take, k - 1)]])
            windows = np.concatenate([x.windows(k)[:max(0, keep - k + 1)], _few(across, k), y.windows(k)[:max(0, take - k + 1)]])
        sketches.append(sketch(windows, bins))
    return Print(n, whole, sketches), keep + common_extension(x, keep, _Part(y, take), 0)


class _Part:
    """A text's beginning as a text of its own."""

    def __init__(self, whole: PrefixHashes, n: int):
        self.span, self.n = whole.span, n


def _ordered(docs: DataFrame, id_col: str, text_col: str, rows_per_bucket: int) -> DataFrame:
    """Rows of whole texts in descending order of their id, (bucket, borrowed, id, text): buckets are
    ranges of ids; the last row of each is followed by a borrowed copy of the next one's first. Null
    ids come last, by the hash of their text, in buckets of hash ranges."""
    key = F.col(f"`{id_col}`")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(key.alias("id"), key.cast("double").alias("at"), text.alias("text"))
    narrow = docs.select(key.cast("double").alias("at"))
    n = narrow.count()
    m = max(1, min(MAX_BUCKETS, n // rows_per_bucket))
    cuts = narrow.agg(F.percentile_approx("at", [i / m for i in range(1, m)], max(10_000, 4 * m))).first()[0] if m > 1 else None
    cuts = sorted(set(cuts or []))  # at most MAX_BUCKETS numbers
    splitter = Bucketizer(splits=[float("-inf"), *cuts, float("inf")] if cuts else [float("-inf"), 0.0, float("inf")],
                          inputCol="at", outputCol="range", handleInvalid="keep")
    last = len(cuts) + 2
    null_hash = F.when(F.col("id").isNull(), F.xxhash64("text"))
    null_bucket = last + 1 + F.shiftright(null_hash, 58) + NULL_BUCKETS // 2

    def placed(df: DataFrame) -> DataFrame:
        return splitter.transform(df).withColumn("bucket", F.when(F.col("id").isNull(), null_bucket)
                                                 .otherwise(last - F.col("range")).cast("int")).drop("range", "at")

    # the first row of each bucket, by id alone, or by hash where there is no id
    heads = placed(rows.where(F.col("id").isNotNull()).select("id", "at", F.lit(None).cast("string").alias("text")))
    heads = heads.groupBy("bucket").agg(F.max("id").alias("head"), F.lit(None).cast("long").alias("head_hash"))
    nulls = placed(rows.where(F.col("id").isNull())).groupBy("bucket").agg(
        F.lit(None).cast(docs.schema[id_col].dataType).alias("head"), F.min(F.xxhash64("text")).alias("head_hash"))
    found = sorted(heads.unionByName(nulls).collect(), key=lambda r: r["bucket"])  # a row a bucket
    lent = [(r["bucket"], r["head"], r["head_hash"], found[i - 1]["bucket"]) for i, r in enumerate(found)]
    id_type = docs.schema[id_col].dataType.simpleString()
    lent = docs.sparkSession.createDataFrame(lent, f"bucket int, head {id_type}, head_hash long, lender int")

    order = F.when(F.col("id").isNull(), F.xxhash64("text"))
    dealt = placed(rows).join(F.broadcast(lent), "bucket")  # a row a bucket
    first = F.when(F.col("id").isNull(), order == F.col("head_hash")).otherwise(F.col("id") == F.col("head"))
    own = F.struct(F.col("bucket").alias("to"), F.lit(False).alias("borrowed"))
    copy = F.struct(F.col("lender").alias("to"), F.lit(True).alias("borrowed"))
    dealt = dealt.withColumn("place", F.explode(F.when(first, F.array(own, copy)).otherwise(F.array(own))))
    dealt = dealt.select(F.col("place.to").alias("bucket"), F.col("place.borrowed").alias("borrowed"), "id", "text")
    return dealt.repartition("bucket").sortWithinPartitions(
        "bucket", "borrowed", F.desc_nulls_last("id"), F.xxhash64("text"))


def compare_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                      rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    common_edited) of every row of ``docs``.

    The next document is the one that follows in descending order of id, the first one after the last.
    The edited text has the last third (rounded down) of the code points replaced by as many of the
    next document's first ones, or all it has. ``near_*`` are likenesses of fingerprints alone;
    ``common_edited`` is the length of the beginning that text and edited text share.

    Null texts read as empty. Ids are whole numbers; null ids come after all others, by the hash of
    their text, as rows with the same id do; rows equal in both are interchangeable. A single document
    follows itself. Very long texts are hashed in pieces. An empty table gives no rows; extra columns
    are not read, whatever their names.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def result(doc_id, n, x, text, print_x, y, next_text, print_y):
        keep, part = n - n // 3, n // 3
        edited = text[:keep] + next_text[:part]
        print_e, common = spliced(x, y, keep, len(edited) - keep)
        return (doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), print_x.text(), print_e.text(),
                likeness(print_x, print_e), likeness(print_x, print_y), common)

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_edited"]

    def run(batches):
        held, out = None, []
        for batch in batches:
            columns = [batch.column(c) for c in ("bucket", "borrowed", "id")]
            for bucket, borrowed, doc_id, raw in zip(*columns, batch.column("text").cast(pa.large_binary())):
                bucket, borrowed, doc_id = bucket.as_py(), borrowed.as_py(), doc_id.as_py()
                if held is None and borrowed:
                    continue  # a tie of the one borrowed row that counts
                text = raw.as_py().decode("utf-8", "replace")
                x = PrefixHashes(code_points(text))
                seen = fingerprint(x)
                if held is not None:
                    out.append(result(*held, x, text, seen))
                held = None if borrowed else (doc_id, len(text), x, text, seen)
                if len(out) >= 512:
                    yield _batch(out, names, batch.schema.field("id").type)
                    out = []
        if out:
            yield _batch(out, names, batch.schema.field("id").type)

    return _ordered(docs, id_col, text_col, rows_per_bucket).mapInArrow(
        run, f"`{id_col}` {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double, common_edited long")


def _batch(rows: list[tuple], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
