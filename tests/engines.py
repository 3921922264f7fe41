"""Runs a query and its SQL on the two engines."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(data: str):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def plain(rows) -> list[str]:
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)


def same(df, sql: str, connection) -> None:
    columns = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*columns).collect())
    found = connection.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == plain(tuple(r[i] for i in at) for r in found.fetchall())
