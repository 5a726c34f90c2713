"""Run a registered query in Spark and its SQL in DuckDB and compare.

Columns are compared by name, rows order-insensitively; doubles are compared
exactly first and, when that fails, within a relative 1e-9 so a report can
tell a real mismatch from last-bit float noise.
"""

from __future__ import annotations

import math
import os

import duckdb

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            v = v.item()
        except Exception:
            pass
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, bool):
        return int(v)
    try:
        from decimal import Decimal
        if isinstance(v, Decimal):
            return float(v)
    except Exception:
        pass
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], out


def _key(t):
    return tuple((0, "") if x is None else (1, repr(x) if not isinstance(x, (int, float)) else f"{float(x):.12e}") for x in t)


def _close(a, b):
    if a == b:
        return True
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1e-9)
    return False


def compare(spark, name: str, fn, sql: str | None, sf_dir: str, con=None) -> dict:
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    res = {"name": name, "spark_rows": len(s_rows)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    con = con or duck(sf_dir)
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    res["oracle_rows"] = len(d_rows)
    sc, sr = _rows(s_cols, s_rows)
    dc, dr = _rows(d_cols, d_rows)
    if sc != dc:
        res["status"] = "schema"
        res["detail"] = f"spark={sc} oracle={dc}"
        return res
    if len(sr) != len(dr):
        res["status"] = "rowcount"
        return res
    sr.sort(key=_key)
    dr.sort(key=_key)
    if sr == dr:
        res["status"] = "exact"
        return res
    for a, b in zip(sr, dr):
        if not all(_close(x, y) for x, y in zip(a, b)):
            res["status"] = "values"
            res["detail"] = f"spark={a} oracle={b}"
            return res
    res["status"] = "close"
    return res
