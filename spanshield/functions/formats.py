"""Report formatting columns (G10): sizes, token counts, optional limits, progress bars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Report glyphs.
INFINITY = "∞"
DASH = "—"
BAR_FULL = "█"
BAR_EMPTY = "░"
BAR_CELLS = 8
BYTE_UNITS = ["KB", "MB", "GB", "TB"]


def _fixed1(x: Column) -> Column:
    """``%.1f`` with correct rounding of the binary value (ties to even), no grouping commas."""
    return F.regexp_replace(F.format_number(x, 1), ",", "")


def format_bytes(b: Column) -> Column:
    """1024-based: ``512 B``, ``1.5 KB``, ``1.0 MB``."""
    expr = F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B")))
    for i, unit in enumerate(BYTE_UNITS):
        lo = 1024 ** (i + 1)
        cond = b < lo * 1024 if i < len(BYTE_UNITS) - 1 else F.lit(True)
        expr = expr.when(cond, F.concat(_fixed1(b.cast("double") / F.lit(float(lo))), F.lit(" " + unit)))
    return F.when(b.isNull(), F.lit(None)).otherwise(expr)


def format_tokens(t: Column) -> Column:
    """1000-based: ``999``, ``1.5K``, ``1.0M``."""
    return (F.when(t < 1000, t.cast("string"))
            .when(t < 1_000_000, F.concat(_fixed1(t.cast("double") / F.lit(1000.0)), F.lit("K")))
            .otherwise(F.concat(_fixed1(t.cast("double") / F.lit(1_000_000.0)), F.lit("M"))))


def format_optional(v: Column) -> Column:
    return F.coalesce(v.cast("string"), F.lit(INFINITY))


def progress_bar(pct: Column) -> Column:
    clamped = F.least(F.greatest(pct, F.lit(0.0)), F.lit(100.0))
    filled = F.floor(clamped / F.lit(12.5)).cast("int")
    return F.concat(F.repeat(F.lit(BAR_FULL), filled), F.repeat(F.lit(BAR_EMPTY), F.lit(BAR_CELLS) - filled))


def percent_text(used: Column, limit: Column) -> Column:
    """Null limit -> ``—``; zero limit -> ``100``; else ``NN%`` (rounded, ties to even)."""
    p = used.cast("double") / limit.cast("double") * F.lit(100.0)
    return (F.when(limit.isNull(), F.lit(DASH)).when(limit == 0, F.lit("100"))
            .otherwise(F.concat(F.regexp_replace(F.format_number(p, 0), ",", ""), F.lit("%"))))


def percent_value(used: Column, limit: Column) -> Column:
    return (F.when(limit.isNull(), F.lit(0.0)).when(limit == 0, F.lit(100.0))
            .otherwise(used.cast("double") / limit.cast("double") * F.lit(100.0)))
