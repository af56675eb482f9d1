"""Local re-run of the driver's correctness gate: Spark query vs DuckDB oracle SQL.

Compares row count, column names and an order-insensitive multiset of rounded row values.
"""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return round(float(v), 6)
    except Exception:  # pragma: no cover
        pass
    return v


def compare(spark_df, con, sql: str) -> dict:
    s_cols = sorted(spark_df.columns)
    s_rows = [tuple(_norm(r[c]) for c in s_cols) for r in spark_df.select(*s_cols).collect()]
    rel = con.execute(sql)
    d_cols_raw = [d[0] for d in rel.description]
    d_rows_raw = rel.fetchall()
    d_cols = sorted(d_cols_raw)
    idx = [d_cols_raw.index(c) for c in d_cols]
    d_rows = [tuple(_norm(r[i]) for i in idx) for r in d_rows_raw]
    res = {"rows_spark": len(s_rows), "rows_oracle": len(d_rows), "cols_match": s_cols == d_cols,
           "spark_cols": s_cols, "oracle_cols": d_cols}
    res["values_match"] = Counter(s_rows) == Counter(d_rows)
    if not res["values_match"]:
        a, b = Counter(s_rows), Counter(d_rows)
        res["only_spark"] = list((a - b).elements())[:5]
        res["only_oracle"] = list((b - a).elements())[:5]
    res["ok"] = res["cols_match"] and res["values_match"] and len(s_rows) == len(d_rows)
    return res
