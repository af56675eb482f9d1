"""SimHash near-dedup by segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments, a point of a grid.
The Manhattan distance of two points never exceeds the Hamming distance of their fingerprints, so
the join looks for points within ``max_bits``: the 32 coordinates form ``max_bits + 2`` groups, of
which at least two must agree in full, and each pair of groups names a cell. Points that share a
cell are held against the Manhattan bound and then against the exact distance.

Fingerprints, not documents, are joined: equal ones are one point. Small cells are joined in SQL.
A larger cell is cut into blocks of bounded size; every pair of blocks is searched breadth-first,
which yields a forest with the same components rather than all pairs.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize

SMALL_CELL = 32
BLOCK = 8192
EVEN_BITS = 0x5555555555555555
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def simhash(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text as an unsigned number; 0 for a text without words."""
    words = _WORD.findall(text.translate(_LOWER))
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[min(shingle, len(words)) - 1:]
    h = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(ends), 65536):  # a very long text in bounded pieces
        digests = np.array([h(line[s:e], seed) for s, e in zip(starts[i:i + 65536], ends[i:i + 65536])], dtype="<u8")
        counts += np.unpackbits(digests.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(ends), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, text_col: str = "text", keep_text: bool = False, shingle: int = 3,
                 seed: int = 42) -> DataFrame:
    """``docs`` with a long column ``fingerprint`` (the 64 bits, signed); the text column is left out
    unless ``keep_text``. Null and wordless texts have fingerprint 0."""
    names = [c for c in docs.columns if c != "fingerprint" and (keep_text or c != text_col)]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("fingerprint", T.LongType())])
    docs = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, text_col])])

    def run(batches):
        for batch in batches:
            texts = batch.column(text_col).cast(pa.large_binary())
            fp = np.array([simhash(t.as_py() or b"", shingle, seed) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(fp)], names=[*names, "fingerprint"])

    return docs.mapInArrow(run, schema)


def embedding(fp: Column) -> Column:
    """The grid point as a long: each two-bit segment's count (0, 1, 2) in unary (00, 01, 11), so
    that the bit count of an XOR of two points is their Manhattan distance."""
    high = F.shiftrightunsigned(fp, 1)
    either, both = fp.bitwiseOR(high).bitwiseAND(F.lit(EVEN_BITS)), fp.bitwiseAND(high).bitwiseAND(F.lit(EVEN_BITS))
    return either.bitwiseOR(F.shiftleft(both, 1))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def cell_masks(max_bits: int) -> list[int]:
    """For each pair of coordinate groups the bits of the point that make the cell. ``max_bits``
    differences touch at most ``max_bits`` of ``max_bits + 2`` groups, so one pair agrees."""
    groups = np.array_split(np.arange(32), max_bits + 2)
    masks = [sum(3 << (2 * int(i)) for i in g) for g in groups]
    return [_signed(a | b) for a, b in itertools.combinations(masks, 2)]


def _forest(x: np.ndarray, y: np.ndarray, same: bool, max_bits: int) -> list[tuple[int, int]]:
    """Edges that join what the links of length <= max_bits between ``x`` and ``y`` (or within ``x``)
    join. Every found point leaves the set that later searches scan."""
    edges = []
    if same:
        rest = x.copy()
        while len(rest):
            frontier, rest = [rest[0]], rest[1:]
            while frontier and len(rest):
                at = frontier.pop()
                near = np.bitwise_count(rest ^ at) <= max_bits
                found, rest = rest[near], rest[~near]
                edges += [(int(at), int(v)) for v in found]
                frontier += found.tolist()
        return edges
    left, right = x.copy(), y.copy()
    while len(left) and len(right):
        frontier, left = [(0, left[0])], left[1:]
        while frontier:
            side, at = frontier.pop()
            other = left if side else right
            near = np.bitwise_count(other ^ at) <= max_bits
            found, other = other[near], other[~near]
            left, right = (other, right) if side else (left, other)
            edges += [(int(at), int(v)) for v in found]
            frontier += [(1 - side, v) for v in found.tolist()]
    return edges


def links(points: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column ``fingerprint``): every pair in small
    cells, a spanning forest of the links in larger ones. Components are those of all links."""
    masks = cell_masks(max_bits)
    cells = points.select("fingerprint", F.posexplode(F.array(*[
        embedding(F.col("fingerprint")).bitwiseAND(F.lit(m)) for m in masks])).alias("grid", "cell"))
    sizes = cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(cells.join(sizes, ["grid", "cell"]), "simhash-cells")

    small = shared.where(F.col("n") <= SMALL_CELL).drop("n")
    a, b = small.alias("a"), small.alias("b")
    near = ((F.col("a.grid") == F.col("b.grid")) & (F.col("a.cell") == F.col("b.cell"))
            & (F.col("a.fingerprint") < F.col("b.fingerprint"))
            & (F.bit_count(embedding(F.col("a.fingerprint")).bitwiseXOR(embedding(F.col("b.fingerprint")))) <= max_bits)
            & (F.bit_count(F.col("a.fingerprint").bitwiseXOR(F.col("b.fingerprint"))) <= max_bits))
    pairs = a.join(b, near).select(F.col("a.fingerprint").alias("u"), F.col("b.fingerprint").alias("v"))

    large = shared.where(F.col("n") > SMALL_CELL)
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    large = large.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select("grid", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fingerprint")

    def search(key, rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fingerprint"].to_numpy().view(np.uint64)
        if key[2] == key[3]:
            edges = _forest(fp, fp, True, max_bits)
        else:
            own = rows["own"].to_numpy() == key[2]
            edges = _forest(fp[own], fp[~own], False, max_bits)
        e = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"u": e[:, 0], "v": e[:, 1]})

    found = large.groupBy("grid", "cell", "i", "j").applyInPandas(search, "u long, v long")
    return pairs.unionByName(found).distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge (u, v). Large-star
    and small-star steps on tables; each round is written, so a lost executor costs one round. More
    than ``max_rounds`` rounds, which no graph of this size needs, are an error."""
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "cc-0")
    mark = _mark(now)
    for i in range(max_rounds):
        if mark[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = materialize(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"cc-{i + 1}")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components not done after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 3, seed: int = 42, keep_rows: bool = False) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links of at
    most ``max_bits`` differing bits, itself included). With ``keep_rows`` instead: ``row`` (a struct of
    all columns of ``docs``, whatever their names), ``component_id`` and ``root``, the smallest
    fingerprint (long) of the component: ids that are null or repeated do not tell components apart,
    it does.

    Null and wordless texts have fingerprint 0 and link like any other. Repeated rows and texts
    share a fingerprint and so a component. Null ids never name a component unless it has no other.
    """
    ids = F.col(f"`{id_col}`").cast("long").alias("doc_id")
    rows = docs.select(ids, F.col(f"`{text_col}`").alias("text"))
    if keep_rows:  # the text goes beside the other columns, once
        others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
        rows = docs.select(ids, F.struct(*others).alias("others"), F.col(f"`{text_col}`").alias("text"))
    printed = materialize(fingerprints(rows, keep_text=keep_rows, shingle=shingle, seed=seed), "simhash-rows")
    points = materialize(printed.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-points")
    roots = components(links(points, max_bits))
    placed = points.join(roots, points["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    out = printed.join(placed.join(names, "root").select("fingerprint", "component_id", "root"), "fingerprint")
    if keep_rows:
        row = F.struct(*[(F.col("text") if c == text_col else F.col("others").getField(c)).alias(c) for c in docs.columns])
        return out.select(row.alias("row"), "component_id", "root")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
