"""Rewriting (C1, C5, C7): mask or tokenize the detected spans of each message.

All narrow: the detections and the rebuilt text are computed in the same projection as the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanshield import patterns as P
from spanshield.functions.spans import rebuild
from spanshield.operators.detect import cached_column, scan, scan_named


def session_key(user: Column, domain: Column) -> Column:
    """``map:session:{user or anon}:{domain}``."""
    return F.concat(F.lit("map:session:"), F.coalesce(user, F.lit(P.ANON_USER)), F.lit(":"), domain)


def type_prefix(vtype: Column) -> Column:
    expr = None
    for t, _, prefix in P.VIOLATION_TYPES:
        expr = (F.when(vtype == t, F.lit(prefix)) if expr is None else expr.when(vtype == t, F.lit(prefix)))
    return expr.otherwise(F.lit("UNK"))


def full_hash(value: Column, skey: Column) -> Column:
    return F.sha2(F.concat(value, skey), 256)


def token_core_of(vtype: Column, value: Column, skey: Column) -> Column:
    """``TYPE_hex``: the first ``TOKEN_HEX_LEN`` hex digits of SHA-256(value || session key)."""
    return F.concat(type_prefix(vtype), F.lit("_"), F.substring(full_hash(value, skey), 1, P.TOKEN_HEX_LEN))


def token_of(vtype: Column, value: Column, skey: Column) -> Column:
    return F.concat(F.lit("["), token_core_of(vtype, value, skey), F.lit("]"))


def mask_text(df: DataFrame, text_col: str, out: str = "masked_text", det_col: str = "detections",
              **scan_kw) -> DataFrame:
    """Replace each detected span by its masked form; keep the detections."""
    rebuilt = cached_column(("rebuild", text_col, det_col, "masked"),
                            lambda: rebuild(F.col(text_col), F.col(det_col), "masked"))
    return df.withColumn(det_col, scan_named(text_col, **scan_kw)).withColumn(out, rebuilt)


def add_tokens(dets: Column, skey: Column) -> Column:
    """Attach ``token``, ``core`` and ``hash`` (full SHA-256, for collision reports) to each detection."""
    return F.transform(dets, lambda d: d.withField("core", token_core_of(d["type"], d["text"], skey))
                       .withField("token", token_of(d["type"], d["text"], skey))
                       .withField("hash", full_hash(d["text"], skey)))


def tokenize(df: DataFrame, text_col: str, user_col: str = "user_id", domain_col: str = "host",
             out: str = "tokenized", det_col: str = "detections", keep=None, **scan_kw) -> DataFrame:
    """Replace each detection by ``[TYPE_hex]`` (deterministic per value and session).

    ``keep``: optional boolean lambda over a detection; detections where it is false are put back
    unchanged (C7: verdict-rejected detections restored before the rebuild, one pass).
    """
    skey = session_key(F.col(user_col), F.col(domain_col))
    if keep is None:
        kw_key = tuple(sorted((k, tuple(v) if isinstance(v, list) else v) for k, v in scan_kw.items()))
        dets = cached_column(("tokens", text_col, "session_key", kw_key),
                             lambda: add_tokens(scan_named(text_col, **scan_kw), F.col("session_key")))
    else:
        dets = F.filter(add_tokens(scan(F.col(text_col), **scan_kw), F.col("session_key")), keep)
    rebuilt = cached_column(("rebuild", text_col, det_col, "token"),
                            lambda: rebuild(F.col(text_col), F.col(det_col), "token"))
    return df.withColumn("session_key", skey).withColumn(det_col, dets).withColumn(out, rebuilt)


def restore_rejected(df: DataFrame, text_col: str, rejected: DataFrame, id_col: str = "msg_id",
                     det_col: str = "detections", out: str = "tokenized") -> DataFrame:
    """Put back the detections that ``rejected`` (id, ord) names, tokenize the others.

    Only detections that are not secrets can be rejected. Messages without any pass by without an
    exchange; the others meet their rejected ordinals, one row a message, by id."""
    asked = F.exists(det_col, lambda d: d["type"] != "SECRET")
    gone = rejected.groupBy(id_col).agg(F.collect_set("ord").alias("_gone"))
    plain = df.where(~F.coalesce(asked, F.lit(False))).withColumn(out, rebuild(F.col(text_col), F.col(det_col), "token"))
    hit = df.where(asked).join(gone, id_col, "left")
    left = F.filter(det_col, lambda d, i: F.col("_gone").isNull() | ~F.array_contains("_gone", i))
    hit = hit.withColumn("_left", left).withColumn(out, rebuild(F.col(text_col), F.col("_left"), "token"))
    return hit.drop("_gone", "_left").unionByName(plain)
