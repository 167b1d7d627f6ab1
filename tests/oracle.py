"""DuckDB over the driver's tables, and an order-free comparison."""

import glob
import os

import duckdb
import pandas as pd


def run_sql(sql: str, folder: str) -> pd.DataFrame:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return con.sql(sql).df()


def rows(df: pd.DataFrame) -> list[tuple]:
    def text(v):
        if pd.isna(v):
            return ""
        return repr(float(v)) if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)]
    for c in df.columns:
        if df[c].dtype.kind in "iu" or str(df[c].dtype).startswith("Int"):
            df = df.assign(**{c: df[c].astype("Float64").astype(object).where(df[c].notna(), None)})
    return sorted(tuple(text(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v) for v in r) for r in df.itertuples(index=False, name=None))


def same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    return sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)
