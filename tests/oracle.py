"""Compares a query's rows with DuckDB's."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v), 7) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(map(value, r)) for r in df[sorted(df)].astype(object).itertuples(index=False)), key=repr)


def assert_same(spark_df, con, sql: str) -> None:
    a, b = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(a) == sorted(b)
    x, y = rows(a), rows(b)
    assert x == y, [p for p in zip(x, y, strict=False) if p[0] != p[1]][:3]
