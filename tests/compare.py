"""Spark rows against DuckDB rows over one folder of tables."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if v != v else v + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def same(df, con, statement: str) -> None:
    rel = con.execute(statement)
    names = [c[0] for c in rel.description]
    theirs = sorted((tuple(str(plain(r[names.index(c)])) for c in sorted(names)) for r in rel.fetchall()))
    assert sorted(names) == sorted(df.columns)
    ours = sorted(tuple(str(plain(r[c])) for c in sorted(df.columns)) for r in df.collect())
    assert ours == theirs
