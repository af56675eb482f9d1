"""Span building blocks: exact match positions, overlap resolution and text rebuild.

All functions return Spark ``Column`` expressions built from JVM built-ins (regex functions and
array higher-order functions), so they run inside the scan stage with no shuffle and no Python.

Offsets are 0-based **character** (code point) positions, ``end`` exclusive.

Positions come from pairing ``regexp_extract_all(text, p, 0)`` (the matches) with
``split(text, p, -1)`` (the gaps between them): both iterate ``Matcher.find`` from the left, so
match *i* starts after gaps 0..i and matches 0..i-1. Exact for patterns that never match the
empty string, which holds for every detector pattern.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN_TYPE = T.StructType([
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("text", T.StringType()),
])

DETECTION_TYPE = T.StructType([
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("masked", T.StringType()),
])


def empty_array(element_type: T.DataType) -> Column:
    return F.array().cast(T.ArrayType(element_type))


CHUNK = 64  # folds run over chunks of this many matches: appending to one long array copies it each time


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once (an expression used twice is copied, and a copy
    inside a lambda is evaluated per element)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunks(items: Column) -> Column:
    """The array cut into arrays of at most ``CHUNK`` elements."""
    return let(items, lambda a: F.when(F.size(a) <= CHUNK, F.array(a)).otherwise(F.transform(
        F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CHUNK).cast("int")), lambda i: F.slice(a, i * CHUNK + 1, F.lit(CHUNK)))))


def find_spans(text: Column, pattern: str, before: int = 0) -> Column:
    """All non-overlapping matches of ``pattern`` as ``array<struct<start, end, text>>``; with
    ``before`` each also has the field ``before``, up to so many characters in front of it.

    Positions are running sums of gap and match lengths. The fold over the matches goes chunk by
    chunk, so its cost grows with the matches, not with their square.
    """
    span_type = SPAN_TYPE if not before else T.StructType([*SPAN_TYPE.fields, T.StructField("before", T.StringType())])
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def pair(g, m):
        near = [F.right(g, F.lit(before)).alias("near")] if before else []
        return F.struct(F.length(g).alias("gl"), m.alias("m"), *near)

    # zip_with pads the shorter array (matches) with null: the last gap has no match after it.
    pairs = F.filter(F.zip_with(gaps, matches, pair), lambda x: x["m"].isNotNull())

    def step(acc, x):
        start = acc["pos"] + x["gl"]
        end = start + F.length(x["m"])
        span = [start.cast("int").alias("start"), end.cast("int").alias("end"), x["m"].alias("text")]
        if not before:
            return F.struct(end.cast("int").alias("pos"), F.concat(acc["spans"], F.array(F.struct(*span))).alias("spans"))
        return let(F.right(F.concat(acc["tail"], x["near"]), F.lit(before)), lambda b: F.struct(
            end.cast("int").alias("pos"), F.concat(acc["spans"], F.array(F.struct(*span, b.alias("before")))).alias("spans"),
            F.right(F.concat(b, F.right(x["m"], F.lit(before))), F.lit(before)).alias("tail")))

    def chunk_step(acc, chunk):
        tail = [acc["tail"].alias("tail")] if before else []
        part = F.aggregate(chunk, F.struct(acc["pos"].alias("pos"), empty_array(span_type).alias("spans"), *tail), step)
        return let(part, lambda r: F.struct(r["pos"].alias("pos"), F.concat(acc["parts"], F.array(r["spans"])).alias("parts"),
                                            *([r["tail"].alias("tail")] if before else [])))

    init = F.struct(F.lit(0).alias("pos"), F.array().cast(T.ArrayType(T.ArrayType(span_type))).alias("parts"),
                    *([F.lit("").alias("tail")] if before else []))
    found = F.flatten(F.aggregate(chunks(pairs), init, chunk_step, lambda acc: acc["parts"]))
    return F.when(text.isNull(), empty_array(span_type)).otherwise(found)


def guarded(cond: Column, spans: Column, element_type: T.DataType = SPAN_TYPE) -> Column:
    """Evaluate ``spans`` only where the cheap necessary condition ``cond`` holds."""
    return F.when(F.coalesce(cond, F.lit(False)), spans).otherwise(empty_array(element_type))


def overlaps(a, b) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def resolve_by_priority(parts: list[Column], element_type: T.DataType = DETECTION_TYPE) -> Column:
    """Join the span arrays of several detectors, highest priority first: a span stays unless it
    overlaps one that an earlier detector placed. Spans of one detector never overlap each other,
    so a text that only one detector finds something in is never compared pair by pair."""
    return F.aggregate(
        F.array(*parts), empty_array(element_type),
        lambda acc, part: F.when(F.size(acc) == 0, part).when(F.size(part) == 0, acc).otherwise(
            F.concat(acc, F.filter(part, lambda x: ~F.exists(acc, lambda a: overlaps(a, x))))))


def sort_by_start(spans: Column) -> Column:
    """Sort a span array by ``start`` (then the other fields): the natural struct order, whose first
    field is ``start``; no comparator lambda is evaluated per pair."""
    return F.array_sort(spans)


def rebuild(text: Column, spans: Column, replacement_field: str) -> Column:
    """Replace every span (sorted, non-overlapping) by its ``replacement_field`` value.

    ``substring`` walks a text from its start; each chunk of spans therefore works on its own piece.
    """
    def chunk_step(acc, chunk):
        last = F.element_at(chunk, -1)["end"]
        piece = F.substring(text, acc["pos"] + 1, last - acc["pos"])

        def step(inner, s):
            gap = F.substring(inner["piece"], inner["pos"] - acc["pos"] + 1, s["start"] - inner["pos"])
            return F.struct(s["end"].alias("pos"), inner["piece"].alias("piece"),
                            F.concat(inner["parts"], F.array(gap, s[replacement_field])).alias("parts"))

        first = F.struct(acc["pos"].alias("pos"), piece.alias("piece"), F.array().cast("array<string>").alias("parts"))
        done = F.aggregate(chunk, first, step, lambda inner: F.array_join(inner["parts"], ""))
        return F.struct(last.alias("pos"), F.concat(acc["parts"], F.array(done)).alias("parts"))

    init = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("parts"))
    built = let(F.aggregate(chunks(spans), init, chunk_step), lambda f: F.array_join(
        F.concat(f["parts"], F.array(F.substring(text, f["pos"] + 1, F.lit(2147483647)))), ""))
    return F.when(F.size(spans) == 0, text).otherwise(built)


def utf8_prefix_bytes(s: Column, max_bytes: int) -> Column:
    """Longest prefix of ``s`` whose UTF-8 encoding has at most ``max_bytes`` bytes.

    Cuts at a character boundary (the 64-byte secret cut-off); only evaluated on the rare rows
    where the byte length is above the limit.
    """
    head = F.substring(s, 1, max_bytes)  # max_bytes chars hold at least max_bytes bytes
    chars = F.split(head, "", -1)
    cut = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(False).alias("full")),
        lambda acc, c: F.when(acc["full"] | (F.octet_length(F.concat(acc["out"], c)) > max_bytes),
                              F.struct(acc["out"].alias("out"), F.lit(True).alias("full")))
        .otherwise(F.struct(F.concat(acc["out"], c).alias("out"), F.lit(False).alias("full"))),
        lambda acc: acc["out"],
    )
    return F.when(F.octet_length(head) <= max_bytes, head).otherwise(cut)


def explode_spans(df, col: str, keep, pos: str | None = None):
    """One row per array element (rows with an empty array vanish), without re-evaluating ``col``.

    A plain ``explode``/``inline`` makes Catalyst infer ``size(col) > 0`` and push it below the
    projection that computes ``col``, which copies the whole detection expression into a Filter
    (the scan would run twice). The ``_outer`` generators are exempt from that rule; the empty
    rows they emit are dropped by a filter on the generated column, which cannot move below.
    """
    from pyspark.sql import functions as F  # local: keep module import surface small
    if pos is None:
        out = df.select(*keep, F.explode_outer(col).alias("_e")).where(F.col("_e").isNotNull())
    else:
        out = df.select(*keep, F.posexplode_outer(col).alias(pos, "_e")).where(F.col("_e").isNotNull())
    return out
