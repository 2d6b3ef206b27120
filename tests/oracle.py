"""Rows of a Spark query and of its SQL in DuckDB, in a form that compares."""

import math
import os
from collections import Counter

import duckdb

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].replace("T00:00:00", "")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def files(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return c


def held(frames):
    c = duckdb.connect()
    for name, df in frames.items():
        c.register(name, df.toArrow())
    return c


def same(df, sql, sf_dir=None, tables=None):
    """As many rows as both have; tables: data frames that take the place of the folder's."""
    cols = sorted(df.columns)
    a = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    q = (held(tables) if tables else files(sf_dir)).sql(sql)
    assert sorted(q.columns) == cols
    b = Counter(tuple(plain(dict(zip(q.columns, r))[c]) for c in cols) for r in q.fetchall())
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
    return sum(a.values())
