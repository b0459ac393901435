"""Compares a query's rows with its SQL twin's, as multisets."""

import math
import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, np.ndarray | list):
        return tuple(map(plain, x))
    if isinstance(x, bool | np.bool_):
        return bool(x)
    if isinstance(x, int | np.integer):
        return float(x)
    if isinstance(x, float | np.floating):
        return None if math.isnan(x) else round(float(x), 6)
    return x


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False))


def same(result: pd.DataFrame, sql: str, folder: str) -> None:
    con = duckdb.connect()
    for t in TABLES.split():
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    expected = con.execute(sql).df()
    assert sorted(result.columns) == sorted(expected.columns)
    assert rows(result) == rows(expected)
