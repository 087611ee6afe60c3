"""Hold a query's rows against its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or (not isinstance(v, list | tuple | dict) and pd.isna(v)):
        return "NULL"
    return repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else repr(v)


def rows(frame):
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))
