"""Compares a query's rows with those of its SQL."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if path.is_dir() else ''}')")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return float(f"{x:.9g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(frame, con, sql) -> str:
    """Empty if both give the same rows."""
    names = frame.columns
    got = rows(names, [tuple(r) for r in frame.collect()])
    cur = con.execute(sql)
    their = [d[0] for d in cur.description]
    want = rows(their, cur.fetchall())
    if sorted(names) != sorted(their):
        return f"columns {sorted(names)} and {sorted(their)}"
    if got != want:
        only, missing = [r for r in got if r not in want][:2] if len(got) < 5000 else got[:2], [r for r in want if r not in got][:2] if len(want) < 5000 else want[:2]
        return f"{len(got)} and {len(want)} rows; for example {only} and {missing}"
    return ""
