"""Compares a query with its SQL over one directory of tables."""

import glob
import math

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    shown = lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)) else (round(float(x), 6) if isinstance(x, (float, int)) and not isinstance(x, bool) else str(x))
    return sorted((tuple(shown(x) for x in r) for r in df.itertuples(index=False)), key=repr)


def same(spark, query, sql):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {f.rpartition('/')[2][:-8]} AS SELECT * FROM '{f}'")
    got, want = query(spark, SF).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
