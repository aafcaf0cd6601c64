"""Side-by-side comparison of a catalog query with its SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=lambda t: tuple(map(repr, t))
    )


def compare(df, con, sql: str) -> str | None:
    """None if names and rows agree, otherwise what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = _rows(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns differ: {sorted(df.columns)} and {sorted(names)}"
    actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    if actual == expected:
        return None
    extra = [r for r in actual if r not in set(expected)][:3]
    missing = [r for r in expected if r not in set(actual)][:3]
    return f"{len(actual)} rows, {len(expected)} expected; extra {extra}; missing {missing}"
