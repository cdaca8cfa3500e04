"""Runs a query and its SQL over the same tables and compares the rows without regard to order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if Path(path).is_dir() else path}'")
    return con


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    return float(v) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(df, sql: str, con: duckdb.DuckDBPyConnection, tolerance: float = 0.0) -> str:
    """Empty if equal, else what differs first."""
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rows(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; {got[:2]} {want[:2]}"
    bad = 0
    first = ""
    for a, b in zip(got, want):
        same = all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= tolerance * max(1, abs(y))) for x, y in zip(a, b))
        if not same:
            bad += 1
            first = first or f"{a} and {b}"
    return f"{bad} of {len(got)} rows: {first}" if bad else ""
