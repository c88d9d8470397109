"""Compares a Spark result with DuckDB's on the same tables: names, row count and values, in any order."""

from __future__ import annotations

import math
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(float(value))
    if isinstance(value, bool) or value is None or isinstance(value, (int, str, bytes)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return repr(value)


def rows(columns, tuples):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(t[i]) for i in order) for t in tuples), key=repr)


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    found = con.execute(sql)
    expected = rows([d[0] for d in found.description], found.fetchall())
    actual = rows(df.columns, [tuple(r) for r in df.collect()])
    if actual[0] != expected[0]:
        return f"columns {actual[0]} and {expected[0]}"
    if len(actual[1]) != len(expected[1]):
        return f"{len(actual[1])} rows and {len(expected[1])}"
    for a, b in zip(actual[1], expected[1]):
        if a != b:
            return f"{a} and {b}"
    return None
