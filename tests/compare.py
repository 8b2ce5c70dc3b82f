"""Run a registered query and its check SQL and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if glob.glob(path):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value):
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else round(value, 9)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return names, sorted(cells, key=repr)


def differences(frame, connection, sql: str) -> str | None:
    """None when both give the same columns, value types and rows; otherwise what differs."""
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    expected_names, expected = _rows(columns, result.fetchall())
    names, actual = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    if names != expected_names:
        return f"columns {names} instead of {expected_names}"
    if len(actual) != len(expected):
        return f"{len(actual)} rows instead of {len(expected)}"
    for have, want in zip(actual, expected):
        if have != want or [type(v) for v in have] != [type(v) for v in want]:
            return f"first difference: {str(have)[:600]} instead of {str(want)[:600]}"
    return None
