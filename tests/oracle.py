"""Runs a query's SQL in DuckDB over the same tables."""

import glob
import os
from numbers import Number

import numpy as np
import pandas as pd


def connect(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for p in glob.glob(folder + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple(None if pd.isna(v) else round(float(v), 9) if isinstance(v, Number) and not isinstance(v, (bool, np.bool_)) else str(v) for v in r))
    return sorted(out, key=str)
