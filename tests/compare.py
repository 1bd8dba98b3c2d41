"""Compares a query with its SQL the way the driver does: columns by name, rows without order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def rows(columns: list[str], data) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([canon(r[i]) for i in order]) for r in data)


#: How DuckDB names the types that queries return.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def compare(spark, sf_dir: str, query, sql: str, con=None) -> int:
    """Asserts that both give the same rows; returns their number."""
    got = query(spark, sf_dir)
    data = [tuple(r) for r in got.collect()]
    want = (con or duck(sf_dir)).sql(sql)
    assert sorted(got.columns) == sorted(want.columns), (got.columns, want.columns)
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert {c: TYPES.get(t, t) for c, t in got.dtypes} == kinds, [(c, t, kinds[c]) for c, t in got.dtypes if TYPES.get(t, t) != kinds[c]]
    a, b = rows(got.columns, data), rows(want.columns, want.fetchall())
    assert len(a) == len(b), (len(a), len(b), [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3])
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)
    return len(a)
