"""Compares a query with its DuckDB twin: sorted column names, sorted rows, typed values."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else str(p) + '/*.parquet'}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, bytearray):
        return bytes(v)
    return v


def table_of(columns, rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v).__name__), str(v)) for v in r))


def difference(df, sql: str, sf_dir: str) -> str:
    """Empty if a DataFrame's rows are those of the SQL; else the first difference."""
    columns, rows = table_of(df.columns, df.collect())
    got = duck(sf_dir).execute(sql)
    want_columns, want = table_of([d[0] for d in got.description], got.fetchall())
    if columns != want_columns:
        return f"columns {columns} and {want_columns}"
    if len(rows) != len(want):
        return f"{len(rows)} rows and {len(want)}: {[r for r in rows if r not in set(want)][:2]} and {[r for r in want if r not in set(rows)][:2]}"
    return next((f"{a} and {b}" for a, b in zip(rows, want, strict=True) if a != b), "")
