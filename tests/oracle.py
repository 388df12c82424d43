"""Holds a query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import pathlib

import duckdb
from pyspark.sql import DataFrame


def cell(x):
    """Values in one form: numbers rounded to nine significant digits, nested values as tuples, times as text."""
    if isinstance(x, (bool, str, bytes)) or x is None:
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, (int, float)):
        x = float(x)
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    if isinstance(x, dict):
        return tuple(sorted((k, cell(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    return x


def in_order(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)), str(v)) for v in r))


def spark_rows(df: DataFrame) -> list[tuple]:
    names = sorted(df.columns)
    return in_order([tuple(cell(r[n]) for n in names) for r in df.collect()])


def duck_rows(sql: str, folder: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(pathlib.Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), in_order([tuple(cell(r[i]) for i in order) for r in got.fetchall()])


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(close, a, b))
    return a == b


def check(df: DataFrame, sql: str, folder: str) -> None:
    names, want = duck_rows(sql, folder)
    assert sorted(df.columns) == names
    got = spark_rows(df)
    assert len(got) == len(want)
    wrong = [(g, w) for g, w in zip(got, want) if not close(g, w)]
    assert not wrong, f"{len(wrong)} of {len(want)} rows differ, first: {wrong[0]}"
