"""Comparison of a Spark result with DuckDB's for the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

from lumenflow.session import TABLES


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = Path(sf, f"{t}.parquet")
        if p.exists():
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def canon(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return "%.9g" % (value + 0.0) if isinstance(value, float) else str(value)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(canon(r[i]) for i in order) for r in data)


def same(df, sql: str, c: duckdb.DuckDBPyConnection) -> None:
    got = c.sql(sql)
    assert sorted(df.columns) == sorted(got.columns)
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(got.columns, got.fetchall())
    assert len(a) == len(b)
    assert a == b, next((x, y) for x, y in zip(a, b, strict=True) if x != y)
