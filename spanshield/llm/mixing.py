"""Mixing sources to target weights.

Every row gets a hash-random key. Within a source, rows are ordered by that key; the key space is
cut into equal ranges (the keys are uniform, so the ranges are even without sampling and the same
on every run), each range is sorted on its own, and a running sum inside the range plus the total
of the ranges before it is the source's prefix sum. Rows of one id share a key: a range that holds
many more rows than its share is cut further, by a hash of the whole row. The mix takes whole epochs
of a source and, of one more pass, the rows up to the exact budget; the row at the cut gives the
words that are left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import WORD_PATTERN, materialize, word_count

ROWS_PER_RANGE = 4096
HOT = 8  # a range with so many times its share of rows is cut


def source_targets(totals: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
                   max_epochs: float = 2.0) -> DataFrame:
    """``totals`` (s_null, s, source_size, n) plus ``target``: ``share`` of all sizes by weight, at
    most ``max_epochs`` times a source's size, what is above reshared by weight among the rest.

    Weights repeat over the sources in code-point order, null last. The reshared limit is a closed
    form: with sources ordered by cap / weight, the first level that no later source's cap
    undercuts. One row per source; a source without words gets target 0.
    """
    by_name = Window.orderBy("s_null", "s")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    t = totals.withColumn("w", w).withColumn("cap", cap).withColumn("r", F.col("cap") / F.col("w"))
    order = Window.orderBy("r", "s_null", "s")
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    zero = F.lit(0.0)
    level = ((F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(below), zero))
             / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(below), zero)))
    t = t.withColumn("level", level)
    t = t.withColumn("limit", F.min(F.when(F.col("level") <= F.col("r"), F.struct("r", "s_null", "s", "level"))).over(everything))
    t = t.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("limit.level") * F.col("w")), F.col("cap")))
    return t.select("s_null", "s", "n", "source_size", "target")


def mix(rows: DataFrame, size: Column, *, id_col: str = "doc_id", source_col: str = "source",
        weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2,
        seed: str = "mix", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """All rows of ``rows`` with ``size``, ``source_size``, ``target`` and ``taken`` (words the mix
    takes of the row, repeats counted) added; columns of these names are replaced.

    Nulls: a null source is a source of its own, a null id sorts as the empty string, a null size
    is 0. Rows without words take 0. Repeated rows are separate rows. Ties of the key are ordered
    by id, then size; rows equal in all three are interchangeable. Where null or repeated ids fill a
    range, a hash of the row comes before the key; only rows equal in every column then stay together
    (map and variant columns have no hash and do not count). An empty table gives no rows.
    """
    keep = [c for c in rows.columns if c not in ("size", "source_size", "target", "taken")]
    hashed = [F.col(f"`{c}`") for c in keep if not any(t in rows.schema[c].dataType.simpleString() for t in ("map<", "variant"))]
    base = rows.select(
        F.xxhash64(F.lit(f"{seed}-row"), *hashed).alias("h"),
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        F.col(source_col).isNull().cast("int").alias("s_null"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("s"),
        F.col(id_col).alias("id"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key"))
    draw = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    narrow = materialize(base.select("s_null", "s", "size", "h", draw.alias("draw")), "mix-sizes")
    totals = narrow.groupBy("s_null", "s").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    n_ranges = F.ceil(F.col("n") / F.lit(rows_per_range)).cast("long")
    targets = materialize(source_targets(totals, weights, share, max_epochs).withColumn("n_ranges", n_ranges), "mix-targets")
    cut = (F.col("draw") * F.col("n_ranges")).bitwiseAND(F.lit((1 << 62) - 1))
    range_of = ["s_null", "s", "range"]

    def ranged(df: DataFrame) -> DataFrame:
        met = df.join(targets.select("s_null", "s", "n_ranges"), ["s_null", "s"])
        return met.withColumn("range", F.shiftright(cut, 32)).drop("n_ranges", "draw")

    hot = (ranged(narrow).groupBy(*range_of).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > HOT * rows_per_range)
           .select(*range_of, F.ceil(F.col("rows") / F.lit(rows_per_range)).cast("long").alias("slices")))
    hot = materialize(hot, "mix-hot")  # no rows where ids are unique

    def sliced(df: DataFrame) -> DataFrame:
        slice_ = F.coalesce(F.pmod(F.col("h"), F.col("slices")), F.lit(0).cast("long"))
        return ranged(df).join(hot, range_of, "left").withColumn("slice", slice_).drop("slices", "h")

    ranges = sliced(narrow).groupBy(*range_of, "slice").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("s_null", "s").orderBy("range", "slice").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("start", F.coalesce(F.sum("range_size").over(earlier), F.lit(0))).drop("range_size")
    ranges = ranges.join(targets.drop("n_ranges"), ["s_null", "s"])

    placed = sliced(base.withColumn("draw", draw)).join(ranges, [*range_of, "slice"])
    upto = (Window.partitionBy(*range_of, "slice").orderBy("key", "id", "size")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.col("start") + F.sum("size").over(upto) - F.col("size")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(0)
    rest = budget - epochs * F.col("source_size") - before
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest))
    return placed.select("row.*", "size", "source_size", F.col("target").cast("double").alias("target"),
                         taken.cast("long").alias("taken"))


def emit_mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
             chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The mixed corpus itself, with the columns of ``docs``, whatever their names: a row for every whole
    pass over a document and one with its first words where the budget ends inside it. Rows that the
    mix does not take, those without words among them, are left out. ``options`` are those of ``mix``."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"))
    mixed = mix(packed, word_count(F.col("row").getField(text_col)), id_col="id", source_col="source", **options)
    full = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(0).cast("int")
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    cuts = F.concat(F.array_repeat(F.lit(0), full), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    rows = mixed.select("row", F.explode(cuts).alias("cut"))
    text = F.col("row").getField(text_col)
    text = F.when(F.col("cut") == 0, text).otherwise(first_words(text, F.col("cut")))
    out = []
    for c in docs.columns:
        value = F.col("row").getField(c)
        if c == text_col:
            value = text
        elif c == chars_col:
            value = F.when(F.col("cut") == 0, value).otherwise(F.length(text)).cast(docs.schema[c].dataType)
        out.append(value.alias(c))
    return rows.select(*out)


def first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words of a text, single spaces between."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD_PATTERN})"), F.lit(1))
    return F.array_join(F.slice(words, F.lit(1), n), " ")


def document_size(text_col: str = "text") -> Column:
    return word_count(F.col(text_col))
