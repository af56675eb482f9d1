"""Detection (span extraction) operators.

Column-level detectors return ``array<struct<start, end, type, text, masked>>``; ``scan`` merges
them by priority (secret prefix, key = value secret, API key, name, e-mail, phone) and keeps a span
only when it overlaps no span kept before it, then sorts by start. Everything is a projection in
the scan stage: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanshield import patterns as P
from spanshield.functions import masks
from spanshield.functions.spans import (
    DETECTION_TYPE,
    SPAN_TYPE,
    empty_array,
    explode_spans,
    find_spans,
    guarded,
    resolve_by_priority,
    sort_by_start,
    utf8_prefix_bytes,
)


def _has(text: Column, *needles: str) -> Column:
    cond = None
    for n in needles:
        c = F.contains(text, F.lit(n))
        cond = c if cond is None else (cond | c)
    return cond


# Necessary conditions per detector (exact: a row failing one cannot hold a match). ``contains`` goes
# byte by byte (``instr`` decodes characters to count them), far cheaper than a regex pass, and most
# rows fail every one of them.
def prefilter_secret_prefix(text: Column) -> Column:
    return _has(text, "k-", "K-", ":")  # sk-/pk- in any case, or authorization: / x-api-key:


def prefilter_secret_kv(text: Column) -> Column:
    return _has(text, ":", "=")


def prefilter_api_key(text: Column) -> Column:
    return _has(text, "k-")


def _cyrillic(text: Column, pattern: str) -> Column:
    """The regex runs only where the first byte of the block's letters occurs (D0 or D1)."""
    raw = text.cast("binary")
    return (F.contains(raw, F.lit(b"\xd0")) | F.contains(raw, F.lit(b"\xd1"))) & text.rlike(pattern)


def prefilter_fio(text: Column) -> Column:
    return F.contains(text.cast("binary"), F.lit(b"\xd0")) & text.rlike("[А-ЯЁ]")


def prefilter_email(text: Column) -> Column:
    return _has(text, "@")


def prefilter_phone(text: Column) -> Column:
    return _has(text, "8", "+7")


def prefilter_company(text: Column) -> Column:
    return _cyrillic(text, "[А-Яа-яЁё]")


def _detection(start: Column, end: Column, vtype: str, text: Column, masked: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"),
                    F.lit(vtype).alias("type"), text.alias("text"), masked.alias("masked"))


def _as_detections(spans: Column, vtype: str, mask_fn, keep=None) -> Column:
    if keep is not None:
        spans = F.filter(spans, keep)
    return F.transform(spans, lambda s: _detection(s["start"], s["end"], vtype, s["text"], mask_fn(s["text"])))


# --- B1 -------------------------------------------------------------------------------------------
def secret_prefix_detections(text: Column, compat: bool = False) -> Column:
    """Prefix secrets: ``sk-``/``pk-``/``authorization:``/``x-api-key:`` + value of >= 16 bytes.

    The value runs to its stop character or the end of the text. One regex takes prefix and value,
    so a prefix inside a value is part of that value. ``compat`` cuts a value that no stop character
    ends at 64 bytes, as the reference does (the rest of the secret then stays in the text).
    """
    found = guarded(prefilter_secret_prefix(text), find_spans(text, P.SECRET_PREFIX_VALUE_RE))

    def candidate(s):
        value = F.regexp_replace(s["text"], "^" + P.SECRET_PREFIX_RE, "")
        if compat:
            cut = F.when(s["end"] == F.length(text), utf8_prefix_bytes(value, P.SECRET_VALUE_MAX_BYTES)).otherwise(value)
            matched = F.left(s["text"], F.length(s["text"]) - F.length(value) + F.length(cut))
        else:
            cut, matched = value, s["text"]
        return F.struct(s["start"].alias("start"), (s["start"] + F.length(matched)).alias("end"),
                        matched.alias("text"), (F.octet_length(cut) >= P.SECRET_VALUE_MIN_BYTES).alias("ok"))

    cands = F.filter(F.transform(found, candidate), lambda c: c["ok"])
    return _as_detections(cands, "SECRET", masks.mask_secret)


# --- B2, B3 ---------------------------------------------------------------------------------------
def secret_kv_detections(text: Column) -> Column:
    return _as_detections(guarded(prefilter_secret_kv(text), find_spans(text, P.SECRET_KV_RE)),
                          "SECRET", masks.mask_secret_kv)


def api_key_detections(text: Column) -> Column:
    return _as_detections(guarded(prefilter_api_key(text), find_spans(text, P.API_KEY_RE)),
                          "SECRET", masks.mask_secret)


# --- B4 -------------------------------------------------------------------------------------------
def is_first_name(word: Column, names=None) -> Column:
    names = names if names is not None else P.first_names()
    return word.isin(list(dict.fromkeys(names)))


def fio_detections(text: Column, names=None) -> Column:
    """2-3 capitalised Cyrillic words, kept when word 1 or 2 is a known first name."""
    def keep(s):
        words = F.slice(F.split(s["text"], f"{P.WS}+", -1), 1, 2)
        return F.exists(words, lambda w: is_first_name(w, names))
    return _as_detections(guarded(prefilter_fio(text), find_spans(text, P.FIO_RE)),
                          "PII_FIO", masks.mask_fio, keep)


# --- B5 -------------------------------------------------------------------------------------------
def email_lookback(before: Column) -> Column:
    """Of up to 60 characters in front of a match the last 60 bytes; empty when that cut splits a
    character."""
    n = P.EMAIL_LOOKBACK_BYTES
    raw = F.encode(before, "UTF-8")
    nb = F.octet_length(raw)
    tail = F.substring(raw, nb - (n - 1), n)
    first = F.hex(F.substring(tail, 1, 1))
    continuation = (first >= F.lit("80")) & (first <= F.lit("BF"))
    return F.when(nb <= n, before).when(continuation, F.lit("")).otherwise(F.decode(tail, "UTF-8"))


IPV4_RE = "^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"


def is_service_address(email: Column, before: Column) -> Column:
    local = F.substring_index(email, "@", 1)
    domain = F.substring_index(email, "@", -1)
    before = email_lookback(before)
    return (F.lower(local).isin(P.SERVICE_USERS)                                   # B5a
            | domain.rlike(IPV4_RE) | domain.contains(":")                          # B5b
            | before.contains("://")                                                # B5c
            | before.endswith("ssh ") | before.endswith("git@") | before.contains("git clone "))  # B5d


EMAIL_SPAN_TYPE = T.StructType([*SPAN_TYPE.fields, T.StructField("before", T.StringType())])


def email_detections(text: Column) -> Column:
    found = find_spans(text, P.EMAIL_RE, before=P.EMAIL_LOOKBACK_BYTES)
    return _as_detections(guarded(prefilter_email(text), found, EMAIL_SPAN_TYPE), "PII_EMAIL", masks.mask_email,
                          lambda s: ~is_service_address(s["text"], s["before"]))


# --- B6 -------------------------------------------------------------------------------------------
def is_valid_phone(s: Column) -> Column:
    digits = F.regexp_replace(s, "[^0-9]", "")
    area = F.substring(digits, 2, 3)
    return ((F.length(digits) == 11) & F.substring(digits, 1, 1).isin("7", "8")
            & (F.startswith(area, F.lit("9")) | area.isin(list(dict.fromkeys(P.LANDLINE_CODES)))))


def phone_detections(text: Column) -> Column:
    return _as_detections(guarded(prefilter_phone(text), find_spans(text, P.PHONE_RE)), "PII_PHONE", masks.mask_phone,
                          lambda s: is_valid_phone(s["text"]))


# --- B7 -------------------------------------------------------------------------------------------
def company_detections(text: Column) -> Column:
    return _as_detections(guarded(prefilter_company(text), find_spans(text, P.COMPANY_RE)), "PII_COMPANY",
                          masks.mask_company)


# --- B8 -------------------------------------------------------------------------------------------
def scan(text: Column, names=None, with_company: bool = False) -> Column:
    """All detections of one text, overlap-resolved by priority and sorted by start."""
    parts = [secret_prefix_detections(text), secret_kv_detections(text), api_key_detections(text),
             fio_detections(text, names)]
    if with_company:
        parts.append(company_detections(text))
    parts += [email_detections(text), phone_detections(text)]
    resolved = sort_by_start(resolve_by_priority(parts, DETECTION_TYPE))
    return F.when(text.isNull() | (F.length(text) == 0), empty_array(DETECTION_TYPE)).otherwise(resolved)


_COLUMN_CACHE: dict = {}


def cached_column(key: tuple, build) -> Column:
    """Build a (large) Column expression once per Spark context and reuse it.

    The detector expressions have thousands of nodes; building them costs thousands of py4j calls
    per query. Unresolved Column objects (referring to columns by name) are reusable JVM objects.
    """
    from pyspark import SparkContext
    sc = getattr(SparkContext, "_active_spark_context", None)
    app = sc.applicationId if sc is not None else None   # ids of objects may come again, this does not
    for old in [k for k in _COLUMN_CACHE if k[0] != app]:
        del _COLUMN_CACHE[old]
    full = (app, key)
    col = _COLUMN_CACHE.get(full)
    if col is None:
        col = build()
        _COLUMN_CACHE[full] = col
    return col


def scan_named(text_col: str, names=None, with_company: bool = False) -> Column:
    """``scan(F.col(text_col))`` built once per context."""
    key = ("scan", text_col, tuple(names) if names is not None else None, with_company)
    return cached_column(key, lambda: scan(F.col(text_col), names=names, with_company=with_company))


DETECTORS = {
    "secret_prefix": secret_prefix_detections,
    "secret_kv": secret_kv_detections,
    "api_key": api_key_detections,
    "fio": fio_detections,
    "email": email_detections,
    "phone": phone_detections,
    "company": company_detections,
}


def detect(df: DataFrame, text_col: str, out: str = "detections", detector: str | None = None, **kw) -> DataFrame:
    """Add ``out`` = the detections of ``text_col`` (one detector, or the full ``scan``)."""
    text = F.col(text_col)
    col = scan_named(text_col, **kw) if detector is None else \
        cached_column(("detector", detector, text_col), lambda: DETECTORS[detector](text))
    return df.withColumn(out, col)


def explode_detections(df: DataFrame, col: str = "detections", keep: list[str] | None = None) -> DataFrame:
    """One row per detection with its ordinal (0-based, by start). Rows without any vanish.

    Uses ``explode_spans`` so the scan expression is evaluated once (see there).
    """
    keep = keep if keep is not None else [c for c in df.columns if c != col]
    return explode_spans(df, col, keep, pos="ord") \
        .select(*keep, "ord", "_e.start", "_e.end", "_e.type", "_e.text", "_e.masked")
