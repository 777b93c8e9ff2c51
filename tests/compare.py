"""Compare a Spark result with the DuckDB result of the same query, ignoring row and column order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return str(value) if not isinstance(value, (int, type(None))) or isinstance(value, bool) else repr(value)


def table_of(columns: list[str], rows) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def differences(df, con, sql: str) -> list[str]:
    got_cols, got = table_of(df.columns, df.collect())
    rel = con.execute(sql)
    want_cols, want = table_of([d[0] for d in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return [f"columns {got_cols} != {want_cols}"]
    if len(got) != len(want):
        only = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        return [f"rows {len(got)} != {len(want)}; {only}"]
    return [f"{g} != {w}" for g, w in zip(got, want) if g != w][:3]
