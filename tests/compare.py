"""Spark rows and DuckDB rows of one query, made comparable."""

import os

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _plain(v):
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    if isinstance(v, int | np.integer):
        return str(int(v))
    if isinstance(v, float | np.floating):
        return repr(round(float(v), 8))
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(_plain, r)) for r in df.itertuples(index=False, name=None))
