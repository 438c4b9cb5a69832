"""A query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb


def shown(v):
    if v is None:
        return "null"
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    return f"{type(v).__name__}:{v}"


def connect(folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.sql(f"create view {f.split('.')[0]} as from '{folder}/{f}'")
    return c


def same_rows(df, sql, folder):
    """The columns, and what either side has that the other has not."""
    cols = sorted(df.columns)
    left = Counter(tuple(shown(r[k]) for k in cols) for r in df.collect())
    rel = connect(folder).sql(sql)
    names, rows = rel.columns, rel.fetchall()
    assert sorted(names) == cols
    at = [names.index(k) for k in cols]
    right = Counter(tuple(shown(r[i]) for i in at) for r in rows)
    assert left == right, (list((left - right).items())[:3], list((right - left).items())[:3])
