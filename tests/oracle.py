"""Compares a query with its SQL in DuckDB over the same tables, without regard to order."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def differences(df, con, sql: str) -> tuple[int, int, list, list]:
    names = sorted(df.columns)
    mine = Counter(tuple(r[c] for c in names) for r in df.collect())
    cur = con.execute(sql)
    at = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(at) == names, (sorted(at), names)
    theirs = Counter(tuple(r[at[c]] for c in names) for r in cur.fetchall())
    return sum(mine.values()), sum(theirs.values()), list((mine - theirs).items())[:4], list((theirs - mine).items())[:4]
