"""Source divergence audit by pair-task sparse merge.

Every source of a language is the sparse sequence of its (term id, count) entries, sorted by id and
cut into segments of bounded length. A task gets one segment of the two sources of an unordered
pair, merges the two by galloping and prices three kinds of terms: those both have, those one has,
and, from the number of terms neither has, the rest. The price of a pair counts both ways.

All shares are exact: ``1 + floor(scale * (count + alpha) / (N + alpha * V))`` in integers.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import materialize

MIN_DOCS = 30
ALPHA = 5
SCALE = 10**9
TOP_TERMS = 50
SEGMENT = 65_536
SALTS = 16
FLUSH = 600_000  # distinct (group, term) entries that a task holds before it hands them on
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_DIGITS = 1000  # the long division goes three digits at a time, so its remainders stay in 64 bits
_PARTIAL = "lang string, source string, term string, n long, docs long"


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs) partial counts of every whole text; null text, lang or source
    is ''. Each task adds up its rows first; one row without a term stands for each group."""
    texts = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n)
                          for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def run(batches):
        held: dict = defaultdict(lambda: (Counter(), Counter()))
        rows: Counter = Counter()

        def emit():
            for (lang, source), (n, found_in) in held.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string(), safe=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, len(n)), pa.repeat(source, len(n)), terms, pa.array(list(n.values()), pa.int64()),
                     pa.array([found_in[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for at, (lang, source, text) in enumerate(zip(langs, sources, batch.column("text").cast(pa.large_binary()))):
                rows[lang, source] += 1
                terms = _TERM.findall(text.as_py().lower())  # bytes: lowers A-Z alone
                n, found_in = held[lang, source]
                n.update(terms)
                found_in.update(set(terms))
                if at % 64 == 0 and sum(len(n) for n, _ in held.values()) > FLUSH:
                    yield from emit()
        yield from emit()
        if rows:
            none = pa.nulls(len(rows), pa.string()), pa.array([0] * len(rows), pa.int64()), pa.array(list(rows.values()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in rows], pa.string()) for i in (0, 1)] + list(none),
                                             names=["lang", "source", "term", "n", "docs"])

    return texts.mapInArrow(run, _PARTIAL)


def share(count: Column, total: Column, kept: Column, alpha: int = ALPHA, scale: int = SCALE) -> Column:
    """``1 + floor(scale * (count + alpha) / (total + alpha * kept))``, exactly."""
    above = F.lit(scale).cast("decimal(10,0)") * (count + F.lit(alpha)).cast("decimal(20,0)")
    below = (total + F.lit(alpha) * kept).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", above, below)


def shares(counts: np.ndarray, total: int, kept: int, alpha: int = ALPHA, scale: int = SCALE) -> np.ndarray:
    """``share`` over an array, by long division; ``scale`` is a power of ten."""
    below = total + alpha * kept
    rest, out, left = counts.astype(np.int64) + alpha, np.zeros(len(counts), np.int64), scale
    while left > 1:
        step = min(_DIGITS, left)
        rest *= step
        out = out * step + rest // below
        rest %= below
        left //= step
    return out + 1


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each id of the sorted ``short`` its place in the sorted ``long``, or -1. Each search starts
    where the one before ended and doubles its step, all ids of a round at once: ids whose step has
    not yet passed them go on, the others close in by halving."""
    if not len(short) or not len(long):
        return np.full(len(short), -1)
    chunk = max(1, int(np.sqrt(len(short))))
    low = np.searchsorted(long, short[::chunk], "left").repeat(chunk)[:len(short)]
    step, high = np.ones(len(short), np.int64), low.copy()
    going = np.flatnonzero(long[np.minimum(high, len(long) - 1)] < short)
    while len(going):
        low[going] = high[going]
        high[going] = np.minimum(high[going] + step[going], len(long))
        step[going] *= 2
        inside = going[high[going] < len(long)]
        going = inside[long[high[inside]] < short[inside]]
    while len(wide := np.flatnonzero(low < high)):
        middle = (low[wide] + high[wide]) // 2
        less = long[middle] < short[wide]
        low[wide] = np.where(less, middle + 1, low[wide])
        high[wide] = np.where(less, high[wide], middle)
    found = np.minimum(low, len(long) - 1)
    return np.where((low < len(long)) & (long[found] == short), found, -1)


def price(ids_a, counts_a, total_a: int, ids_b, counts_b, total_b: int, kept: int) -> tuple[int, int]:
    """The summed difference of shares over the terms that one or both of two sorted segments have,
    and the number of these terms."""
    p, q = shares(counts_a, total_a, kept), shares(counts_b, total_b, kept)
    none = np.zeros(1, np.int64)
    p_none, q_none = int(shares(none, total_a, kept)[0]), int(shares(none, total_b, kept)[0])
    if len(ids_a) <= len(ids_b):
        at = gallop(ids_a, ids_b)
        both_a, both_b = np.flatnonzero(at >= 0), at[at >= 0]
    else:
        at = gallop(ids_b, ids_a)
        both_a, both_b = at[at >= 0], np.flatnonzero(at >= 0)
    only_a, only_b = np.ones(len(ids_a), bool), np.ones(len(ids_b), bool)
    only_a[both_a] = False
    only_b[both_b] = False
    value = np.abs(p[both_a] - q[both_b]).sum() + np.abs(p[only_a] - q_none).sum() + np.abs(q[only_b] - p_none).sum()
    return int(value), len(ids_a) + len(ids_b) - len(both_a)


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The sorted ids and counts of the one segment of a co-group's side, none if it has none."""
    if not table.num_rows:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return tuple(table.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "counts"))


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, segment: int = SEGMENT) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) group of ``docs``.

    Part ``pair``: every other source of the language, ``value`` the summed difference of the two
    sources' shares over all kept terms (those in ``min_docs`` documents of the language or more).
    Part ``term``: the ``top_terms`` kept terms whose share in the group exceeds that in the language
    the most. Ranks go by value, descending, then by the item's UTF-8 bytes.

    Null text, lang and source read as ''. Empty texts and groups without any kept term have their
    pairs still (0 where the language keeps none). Repeated rows count as documents of their own; an
    empty table gives no rows; other columns are not read, whatever their names.
    """
    counted = materialize(term_counts(docs, text_col, lang_col, source_col).groupBy("lang", "source", "term")
                          .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "audit-counts")
    # a term's list has at most one entry a source
    terms = (counted.where(F.col("term").isNotNull()).groupBy("lang", "term")
             .agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("uses"))
             .where(F.col("docs") >= min_docs))
    terms = materialize(terms.select("lang", "term", "lang_n", "uses"), "audit-terms")
    cuts = max(1, -(-terms.count() // segment))
    terms = terms.withColumn("cut", F.pmod(F.xxhash64("term"), F.lit(cuts)))
    # an id is a term's place in its cut: about ``segment`` terms in order
    placed = terms.withColumn("id", F.row_number().over(Window.partitionBy("lang", "cut").orderBy("term")))
    uses = terms.select("lang", "term", "lang_n", F.explode("uses").alias("use")).select(
        "lang", "use.source", "term", "lang_n", "use.n")

    langs = terms.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("kept"))
    totals = uses.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = counted.where(F.col("term").isNull()).select("lang", "source").distinct()
    groups = materialize(groups.join(totals, ["lang", "source"], "left").join(langs, ["lang"], "left").select(
        "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "lang_total", "kept")]), "audit-groups")

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    parts = []
    # part term: one row per use meets its group's totals, salted because a source may hold most uses
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select(
        "lang", "source", "salt", "total", "lang_total", "kept")
    excess = (share(F.col("n"), F.col("total"), F.col("kept")) - share(F.col("lang_n"), F.col("lang_total"), F.col("kept")))
    more = (uses.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "source", "salt"])
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess.alias("value"))
            .where(F.col("value") > 0))
    parts.append(more.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_terms))

    # part pair: segments of both sides of each unordered pair
    one, other = groups.alias("x"), groups.alias("y")
    pairs = one.join(other, (F.col("x.lang") == F.col("y.lang")) & (F.col("x.source") < F.col("y.source"))).select(
        "x.lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), "x.kept",
        F.col("x.total").alias("total_a"), F.col("y.total").alias("total_b"))
    pairs = materialize(pairs, "audit-pairs")
    entries = F.sort_array(F.collect_list(F.struct("id", "use.n")))
    segments = placed.select("lang", "cut", "id", F.explode("uses").alias("use")).groupBy("lang", "use.source", "cut").agg(entries.alias("e"))
    segments = materialize(segments.select("lang", "source", "cut", F.col("e.id").alias("ids"), F.col("e.n").alias("counts")), "audit-segments")

    def side(name: str) -> DataFrame:
        meets = pairs.withColumnRenamed(name, "source").join(segments, ["lang", "source"]).withColumnRenamed("source", name)
        columns = ["lang", "a", "b", "cut", "kept", "total_a", "total_b", "ids", "counts"]
        return meets.select(*columns).toDF(*columns)  # fresh columns: both sides come from the same tables

    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("lang", "a", "b")]
                          + [T.StructField(c, T.LongType()) for c in ("value", "terms")])

    def merge(key, left: pa.Table, right: pa.Table) -> pa.Table:
        has = left if left.num_rows else right
        kept, total_a, total_b = (has.column(c)[0].as_py() for c in ("kept", "total_a", "total_b"))
        value, terms_met = price(*_entries(left), total_a, *_entries(right), total_b, kept)
        return pa.table({"lang": [key[0].as_py()], "a": [key[1].as_py()], "b": [key[2].as_py()], "value": [value], "terms": [terms_met]})

    keys = ["lang", "a", "b", "cut"]
    priced = side("a").groupBy(*keys).cogroup(side("b").groupBy(*keys)).applyInArrow(merge, schema)
    priced = priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    absent = F.abs(share(zero, F.col("total_a"), F.col("kept")) - share(zero, F.col("total_b"), F.col("kept")))
    rest = absent * (F.col("kept") - F.coalesce("terms", zero))
    value = F.when(F.col("kept") == 0, zero).otherwise(F.coalesce("value", zero) + rest)
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("way")
    distances = pairs.join(priced, ["lang", "a", "b"], "left").select("lang", value.cast("long").alias("value"), both)
    distances = distances.select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    parts.append(distances.withColumn("rank", F.row_number().over(ranked)))
    return parts[1].unionByName(parts[0])
