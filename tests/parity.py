"""Spark-vs-DuckDB parity helpers (used by tests and by hand)."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

from pricefold.sources.tables import TABLES, table_path


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = table_path(sf_dir, t)
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, (list, tuple)) or (hasattr(v, "tolist") and getattr(v, "ndim", 0) > 0):
        return tuple(_norm(x) for x in (v.tolist() if hasattr(v, "tolist") else v))
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            v = v.item()
        except Exception:
            pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "isoformat"):
        return str(v)[:10] if len(str(v)) >= 10 and str(v)[10:].strip("0: ") == "" else str(v)
    return v


def frame_rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark_df, sql: str, con, rel_tol: float = 0.0):
    """Return (ok, message). rel_tol=0 means exact after the query's own rounding."""
    a = spark_df.toPandas()
    b = con.sql(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return False, f"columns differ: {sorted(a.columns)} vs {sorted(b.columns)}"
    if len(a) != len(b):
        return False, f"row count {len(a)} vs {len(b)}"
    ra, rb = frame_rows(a), frame_rows(b)
    bad = 0
    first = None
    for x, y in zip(ra, rb):
        for u, v in zip(x, y):
            if u == v:
                continue
            if isinstance(u, (int, float)) and isinstance(v, (int, float)) and rel_tol > 0:
                if math.isclose(u, v, rel_tol=rel_tol, abs_tol=1e-9):
                    continue
            bad += 1
            if first is None:
                first = (x, y)
            break
    if bad:
        return False, f"{bad} rows differ; first: {first}"
    return True, f"{len(a)} rows equal"
