"""Embedded attachments (B11-B13, C6 for payloads, H5 input).

Data URIs inside message bodies are extracted in-row (regex + base64 decode), classified by magic
bytes, and scanned with the same detector as the body. Each attachment row keeps its message id,
so rewriting the body is a regroup by message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanshield.functions.spans import explode_spans, rebuild
from spanshield.operators.detect import scan
from spanshield.operators.rewrite import add_tokens, session_key

# The data-URI pattern (quotes included), strict padded base64, the blocked marker.
DATA_URI_RE = '"data:([^";]+);base64,([^"]+)"'
BASE64_RE = "^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/][AQgw]==|[A-Za-z0-9+/]{2}[AEIMQUYcgkosw048]=)?$"
BLOCKED_TEXT = "[BLOCKED: uninspectable content]"
BLOCKED_TOKEN = "BLOCKED"
# Magic-byte prefixes (hex) checked in order -> format.
MAGIC = [("25504446", "application"), ("504B0304", "application"), ("FFD8", "image"), ("89504E47", "image"),
         ("47494638", "image"), ("424D", "image")]
NON_PRINTABLE_RE = "[\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F]"
TEXT_PRINTABLE_RATIO = 0.95


def b64encode(data: Column) -> Column:
    """Standard padded base64 on one line (Spark's ``base64`` may wrap lines MIME-style)."""
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


def data_uris(body: Column) -> Column:
    """``array<struct<idx, uri, mime, b64, bytes>>`` of decodable data URIs (1-based index;
    undecodable ones are skipped and take no index)."""
    uris = F.regexp_extract_all(body, F.lit(DATA_URI_RE), F.lit(0))
    parsed = F.transform(uris, lambda u: F.struct(
        u.alias("uri"), F.regexp_extract(u, DATA_URI_RE, 1).alias("mime"), F.regexp_extract(u, DATA_URI_RE, 2).alias("b64")))
    ok = F.filter(parsed, lambda p: p["b64"].rlike(BASE64_RE))
    return F.transform(ok, lambda p, i: F.struct((i + 1).alias("idx"), p["uri"].alias("uri"), p["mime"].alias("mime"),
                                                   p["b64"].alias("b64"), F.unbase64(p["b64"]).alias("bytes")))


def classify_format(data: Column) -> Column:
    """Empty -> binary; magic bytes -> application / image; valid UTF-8 with > 95 % printable
    bytes -> text; else binary."""
    head = F.hex(F.substring(data, 1, 12))
    riff_webp = F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250")
    expr = F.when(F.octet_length(data) == 0, F.lit("binary"))
    for magic, fmt in MAGIC:
        expr = expr.when(F.startswith(head, F.lit(magic)), F.lit(fmt))
        if magic == "47494638":
            expr = expr.when(riff_webp, F.lit("image"))
    s = data.cast("string")
    nonprint = F.length(s) - F.length(F.regexp_replace(s, NON_PRINTABLE_RE, ""))
    printable = (F.octet_length(data) - nonprint) / F.octet_length(data)
    text = F.is_valid_utf8(s) & (printable > F.lit(TEXT_PRINTABLE_RATIO))
    return expr.when(text, F.lit("text")).otherwise(F.lit("binary"))


def extract_attachments(df: DataFrame, body_col: str = "body", keep=("msg_id",)) -> DataFrame:
    """B11 + B12 as rows: one per decodable attachment with its format and lossy text."""
    a = df.select(*keep, data_uris(F.col(body_col)).alias("_a"))
    ex = explode_spans(a, "_a", list(keep)).select(*keep, "_e.*")
    return ex.withColumn("format", classify_format(F.col("bytes"))) \
        .withColumn("text", F.make_valid_utf8(F.col("bytes").cast("string")))


def scan_attachments(att: DataFrame, user_col: str = "user_id", domain_col: str = "host") -> DataFrame:
    """Text -> tokenize and re-encode (``masked``); other formats -> any detection blocks the
    payload (``blocked``); no detection -> ``pass``. Adds ``replacement`` (the new data URI or null)
    and ``detections`` (with tokens; ``BLOCKED`` for blocked payloads)."""
    skey = session_key(F.col(user_col), F.col(domain_col))
    dets = add_tokens(scan(F.col("text")), skey)
    is_text = F.col("format") == "text"
    a = att.withColumn("detections", dets)
    has = F.size("detections") > 0
    outcome = F.when(~has, F.lit("pass")).when(is_text, F.lit("masked")).otherwise(F.lit("blocked"))
    new_payload = F.when(is_text, b64encode(F.encode(rebuild(F.col("text"), F.col("detections"), "token"), "UTF-8"))) \
        .otherwise(b64encode(F.lit(BLOCKED_TEXT).cast("binary")))
    replacement = F.when(has, F.concat(F.lit('"data:'), F.col("mime"), F.lit(";base64,"), new_payload, F.lit('"')))
    blocked_dets = F.transform("detections", lambda d: d.withField("token", F.lit(BLOCKED_TOKEN)))
    return a.withColumn("outcome", outcome).withColumn("replacement", replacement) \
        .withColumn("detections", F.when(is_text, F.col("detections")).otherwise(blocked_dets))


def rewrite_attachments(messages: DataFrame, scanned: DataFrame, body_col: str = "body",
                        id_col: str = "msg_id", out: str = "body_out") -> DataFrame:
    """C6 for payloads: every occurrence of a replaced data URI is rewritten (as the reference's
    whole-string replace does). Messages without a replacement pass through."""
    rep = scanned.where(F.col("replacement").isNotNull()).groupBy(id_col).agg(
        F.collect_list(F.struct("idx", "uri", "replacement")).alias("_r"))
    j = messages.join(rep, id_col, "left")
    done = F.aggregate(F.coalesce(F.array_sort("_r"), F.array().cast("array<struct<idx:int,uri:string,replacement:string>>")),
                       F.col(body_col), lambda acc, r: F.replace(acc, r["uri"], r["replacement"]))
    return j.withColumn(out, done).drop("_r")
