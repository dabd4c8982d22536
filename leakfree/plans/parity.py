"""Compare a registered query with its SQL oracle (DuckDB), the way the driver does:
columns sorted by name, rows compared order-insensitively, doubles to 6 decimals."""

from __future__ import annotations

import math

import pandas as pd

from leakfree.sources.bindings import TABLES


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir.rstrip('/')}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return "<null>"
    if isinstance(v, float):
        return "<null>" if math.isnan(v) else f"{v:.6f}"
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def canonical(pdf: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(_norm(x) for x in rec) for rec in pdf[cols].itertuples(index=False))


def compare(spark_pdf: pd.DataFrame, sql_pdf: pd.DataFrame) -> str | None:
    """None when equal, else a short description of the first difference."""
    c1, r1 = canonical(spark_pdf)
    c2, r2 = canonical(sql_pdf)
    if c1 != c2:
        return f"columns differ: {c1} vs {c2}"
    if len(r1) != len(r2):
        return f"row counts differ: {len(r1)} vs {len(r2)}"
    for a, b in zip(r1, r2):
        if a != b:
            return f"first differing row: {a} vs {b}"
    return None
