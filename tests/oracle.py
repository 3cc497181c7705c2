"""Comparison of a registered query with its DuckDB twin."""

from __future__ import annotations

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return round(float(v), 6) if isinstance(v, decimal.Decimal) else v


def rows_of_spark(df) -> list[str]:
    columns = sorted(df.columns)
    return sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())


def rows_of_duck(con, sql: str) -> tuple[list[str], list[str]]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(repr(tuple(plain(r[k]) for k in order)) for r in cur.fetchall())
