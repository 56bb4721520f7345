"""Compare registered queries with their oracle text in DuckDB."""
from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), na_position="first", kind="mergesort").reset_index(drop=True)


def differences(spark_df: pd.DataFrame, oracle_df: pd.DataFrame, tol: float = 0.0) -> str | None:
    if sorted(spark_df.columns) != sorted(oracle_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(oracle_df.columns)}"
    if len(spark_df) != len(oracle_df):
        return f"rows {len(spark_df)} vs {len(oracle_df)}"
    a, b = canonical(spark_df), canonical(oracle_df)
    for c in a.columns:
        ka, kb = a[c].dtype.kind, b[c].dtype.kind
        if a[c].isna().any() or b[c].isna().any():
            ka = kb = "f" if ka in "if" and kb in "if" else ka
        if ka != kb and {ka, kb} != {"O"}:
            return f"{c}: dtype {a[c].dtype} vs {b[c].dtype}"
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if tol and ka == "f":
            same |= (a[c] - b[c]).abs() <= tol
        if not same.all():
            i = int((~same).to_numpy().nonzero()[0][0])
            return f"{c}: {int((~same).sum())} of {len(a)} differ, first {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}"
    return None
