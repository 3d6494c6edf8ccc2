"""Runs a query and its SQL side by side, as the driver does."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    return str(x)


def differences(df, con, sql: str, limit: int = 3) -> list[str]:
    """What differs between a DataFrame and SQL: columns, number of rows, values."""
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    want_rows = res.fetchall()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    cols = sorted(names)
    got = sorted(tuple(_cell(r[c]) for c in cols) for r in df.collect())
    want = sorted(tuple(_cell(r[names.index(c)]) for c in cols) for r in want_rows)
    if len(got) != len(want):
        return [f"{len(got)} rows and {len(want)}"]
    return [f"{g} and {w}" for g, w in zip(got, want) if g != w][:limit]
