"""Run a query and its SQL twin over the same tables and compare their rows."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd

SMALL = "/root/testdata/sf0.001"


def connect(sf_dir: str = SMALL) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return con


def _rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    clean = lambda x: None if x is None or x is pd.NA or (isinstance(x, (float, np.floating)) and np.isnan(x)) else round(float(x), 6) if isinstance(x, (float, np.floating)) else int(x) if isinstance(x, (int, np.integer)) and not isinstance(x, (bool, np.bool_)) else x
    return sorted((tuple(clean(x) for x in r) for r in df.itertuples(index=False)), key=repr)


def same(spark_df, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    got, want = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)
