"""Rows of a query against those of its DuckDB SQL."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    plain = [tuple(None if pd.isna(x) else round(x, 6) if isinstance(x, float) else str(x) for x in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(plain, key=lambda r: tuple((x is None, str(x)) for x in r))


def same(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> None:
    assert sorted(spark_frame.columns) == sorted(sql_frame.columns)
    assert rows_of(spark_frame) == rows_of(sql_frame)
