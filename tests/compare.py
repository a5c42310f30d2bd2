"""Rows of a Spark query and of its SQL in one comparable form."""

import glob
import os

import duckdb
import pandas as pd


def tables(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def _cell(x) -> str:
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return "∅"
    if isinstance(x, float):
        return str(int(x)) if x.is_integer() else repr(round(x, 6))
    return str(x)


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(_cell, r)) for r in df.itertuples(index=False, name=None))
