"""Runs a query and its SQL twin and compares rows, whatever their order."""

import os

import duckdb
import numpy as np
import pandas as pd


def duck(sf, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in sorted(os.listdir(sf)):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{t}'")
    return con.execute(sql).df()


def _value(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([_value(x) for x in v])
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return "~"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return str(int(v)) if float(v).is_integer() and abs(v) < 1e15 else repr(round(float(v), 9))
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(_value, r)) for r in df.itertuples(index=False))


def check(spark, sf, query, sql):
    got = query(spark, sf).toPandas()
    want = duck(sf, sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
