"""Comparison of a registered query with its SQL in DuckDB."""

import os

import duckdb
import pandas as pd


def connection(sf_dir: str):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{f}"
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def absent(v) -> bool:
    return v is None or v is pd.NA or (isinstance(v, float) and v != v)


def same(a, b) -> bool:
    if absent(a) or absent(b):
        return absent(a) and absent(b)
    if isinstance(a, float) or isinstance(b, float):
        return abs(float(a) - float(b)) <= 2e-6 * max(1.0, abs(float(b)))
    return a == b


def assert_same(found: pd.DataFrame, wanted: pd.DataFrame) -> None:
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    key = lambda row: [("" if absent(v) else f"{float(v):.4f}" if isinstance(v, float) else str(v)) for v in row]
    a = sorted(found[columns].astype(object).values.tolist(), key=key)
    b = sorted(wanted[columns].astype(object).values.tolist(), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(same(p, q) for p, q in zip(x, y, strict=True)), (columns, x, y)
