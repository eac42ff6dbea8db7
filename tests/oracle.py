"""Comparison of a Spark result with the result of its SQL counterpart."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(value: object) -> object:
    """Comparable form that keeps kinds apart: text, truth value, whole number, fraction."""
    if isinstance(value, bool) or value is None or isinstance(value, (str, int)):
        return (type(value).__name__, value)
    if isinstance(value, float):
        return ("float", None if math.isnan(value) else value)
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, (datetime.datetime, datetime.date)):
        return ("time", value.isoformat())
    return (type(value).__name__, str(value))


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(row[i]) for i in order) for row in rows), key=repr)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when names, row counts and values agree."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return [f"columns: {sorted(df.columns)} != {sorted(names)}"]
    if len(got) != len(want):
        return [f"rows: {len(got)} != {len(want)}"] + [f"{a} | {b}" for a, b in zip(got, want) if a != b][:2]
    return [f"{a}\n    != {b}" for a, b in zip(got, want) if a != b][:3]
