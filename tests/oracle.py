"""Rows of a Spark query and of its oracle, side by side."""

from __future__ import annotations

import os

import duckdb

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def _cell(v):
    if hasattr(v, "isoformat"):
        return str(v)[:19].removesuffix(" 00:00:00")
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def differences(df, sql: str, con) -> str:
    """Empty if the rows are equal, regardless of order."""
    cols = sorted(df.columns)
    mine = sorted(([_cell(r[c]) for c in cols] for r in df.collect()), key=repr)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = sorted(([_cell(r[i]) for i in at] for r in cur.fetchall()), key=repr)
    if mine == theirs:
        return ""
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(mine)} and {len(theirs)} rows of {cols}; {len(bad)} differ: {bad[:2]}"
