"""Comparison of a query with its SQL, as rows without order."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
from pathlib import Path

import duckdb

DATA = Path(os.environ.get("KITELOOM_DATA", "/root/testdata"))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences between a DataFrame and a statement; empty where they agree."""
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    problems = []
    if got_columns != want_columns:
        problems.append(f"columns {got_columns} / {want_columns}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} / {len(want)}")
    if not problems and got != want:
        problems.append(next(f"{a} / {b}" for a, b in zip(got, want) if a != b))
    return problems
