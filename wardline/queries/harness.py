"""Run registered queries and their DuckDB counterparts on the same files and compare the rows."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
import time
from collections import Counter
from decimal import Decimal


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple((type(c).__name__, c) for c in (_cell(r[i]) for i in order)) for r in rows)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def compare(spark, con, sf_dir, name, fn, sql):
    """(ok, message) for one query."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return bool(rows), f"{len(rows)} rows (no SQL) spark {t1 - t0:.1f}s"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    took = f"{len(rows)} rows spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = _rows(df.columns, rows), _rows(names, want)
    if a != b:
        left, right = list((a - b).items())[:2], list((b - a).items())[:2]
        return False, f"{len(rows)} vs {len(want)} rows; only spark {left}; only sql {right}"
    return bool(rows), took
