"""Compares registered queries with their SQL, as the driver does: sorted columns, any row order."""

from __future__ import annotations

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, float):
        return repr(x + 0.0)
    if isinstance(x, bool):
        return str(x)
    return str(x)


def compare(spark, sf_dir: str, f, sql: str) -> str:
    """Empty if equal, else what differs."""
    got = f(spark, sf_dir)
    names = sorted(got.columns)
    left = sorted(tuple(map(_cell, r)) for r in got.select(*names).collect())
    c = duck(sf_dir).execute(sql)
    order = [d[0] for d in c.description]
    if sorted(order) != names:
        return f"columns {names} and {sorted(order)}"
    at = [order.index(n) for n in names]
    right = sorted(tuple(_cell(r[i]) for i in at) for r in c.fetchall())
    if len(left) != len(right):
        return f"{len(left)} and {len(right)} rows"
    bad = [(a, b) for a, b in zip(left, right, strict=True) if a != b]
    return f"{len(bad)} of {len(left)} rows differ, such as {names}: {bad[0]}" if bad else ""
