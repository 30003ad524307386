"""Spark results against DuckDB on the same tables."""

import os

import duckdb
import numpy as np
import pandas as pd


def cell(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
        return None
    if isinstance(x, (list, np.ndarray)):
        return str([cell(v) for v in x])
    return repr(float(x)) if isinstance(x, (float, np.floating)) else str(x)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df.reindex(sorted(df.columns), axis=1)
    floats = {c for c in df.columns if df[c].dtype.kind == "f"}
    return sorted((tuple(cell(float(v)) if c in floats and v is not None else cell(v) for c, v in zip(df.columns, r, strict=True)) for r in df.itertuples(index=False)), key=str)


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    return con


def differs(spark_df, con, sql: str) -> str:
    got, want = spark_df.toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    return "" if a == b else f"{len(a)} and {len(b)} rows; {[x for x in a if x not in b][:2]} {[x for x in b if x not in a][:2]}"
