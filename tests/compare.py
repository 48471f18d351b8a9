"""Result sets compared as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        kind = str(out[c].dtype).lower()
        if "int" in kind or "float" in kind:
            out[c] = out[c].astype(float) + 0.0
        else:
            out[c] = out[c].map(lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else str(v))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def same(a: pd.DataFrame, b: pd.DataFrame, tolerance: float = 2e-3) -> str:
    """What differs, or nothing."""
    a, b = normal(a), normal(b)
    if list(a.columns) != list(b.columns) or len(a) != len(b):
        return f"{list(a.columns)} {len(a)} against {list(b.columns)} {len(b)}"
    for c in a.columns:
        x, y = a[c], b[c]
        equal = np.isclose(x, y, atol=tolerance, rtol=1e-6, equal_nan=True) if x.dtype == float and y.dtype == float else ((x == y) | (x.isna() & y.isna())).to_numpy()
        if not equal.all():
            i = int(np.argmin(equal))
            return f"{c}: {int((~equal).sum())} differ, {x[i]!r} against {y[i]!r}"
    return ""
