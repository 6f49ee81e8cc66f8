"""Compare a registered query with its SQL on the same files."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    if isinstance(value, Decimal):
        return ("decimal", str(value))
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    result = [tuple((type(plain(r[i])).__name__, plain(r[i])) for i in order) for r in rows]
    return [names[i] for i in order], sorted(result, key=repr)


def difference(df, con, sql: str) -> str | None:
    found = con.execute(sql)
    want_names, want = rows_of([d[0] for d in found.description], found.fetchall())
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None
