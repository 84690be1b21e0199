"""Comparison of a query with its SQL, as values without order."""

import datetime
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def close(a, b):
    if isinstance(a, float) and isinstance(b, (float, int)) or isinstance(b, float) and isinstance(a, (float, int)):
        return abs(a - b) <= 1e-5 * max(1.0, abs(a))
    return a == b


def same(df, con, sql):
    columns = sorted(df.columns)
    ours = sorted(([plain(x) for x in r] for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=str)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted(([plain(r[i]) for i in at] for r in cur.fetchall()), key=str)
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    bad = [(a, b) for a, b in zip(ours, theirs) if not all(map(close, a, b))]
    assert not bad, bad[:3]
