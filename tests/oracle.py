"""Holds a Spark query against its SQL in DuckDB: rows, columns and values, order aside."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    db = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def _plain(x):
    return float(x) if isinstance(x, Decimal) else x.replace(tzinfo=None) if hasattr(x, "tzinfo") else list(map(_plain, x)) if isinstance(x, list) else x


def compare(df, db, sql: str) -> tuple[int, str]:
    """Number of rows, and what differs ('' if nothing does)."""
    cursor = db.execute(sql)
    names = [c[0] for c in cursor.description]
    want_columns, got_columns = sorted(names), sorted(df.columns)
    if want_columns != got_columns:
        return 0, f"columns {got_columns}, wanted {want_columns}"
    at = [names.index(c) for c in want_columns]
    key = lambda row: [(x is None, str(type(x)), str(x)) for x in row]
    want = sorted((tuple(_plain(r[i]) for i in at) for r in cursor.fetchall()), key=key)
    got = sorted((tuple(_plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in want_columns]).collect()), key=key)
    if want == got:
        return len(got), ""
    first = next(((g, w) for g, w in zip(got, want) if g != w), (None, None))
    return len(got), f"{len(got)} rows, wanted {len(want)}; first difference in {want_columns}: {str(first[0])[:300]} and {str(first[1])[:300]}"
