"""Runs registered queries and their SQL side by side and compares names, counts and values."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def differences(spark, query, sql: str, folder: str, c=None) -> list[str]:
    df = query(spark, folder)
    cur = (c or connect(folder)).execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)}, SQL {sorted(names)}"]
    order = sorted(names)
    want = sorted(tuple(plain(r[names.index(n)]) for n in order) for r in cur.fetchall())
    got = sorted(tuple(plain(r[n]) for n in order) for r in df.collect())
    if got == want:
        return []
    a, b = set(got) - set(want), set(want) - set(got)
    return [f"{len(got)} rows, SQL {len(want)}; only here {sorted(a)[:3]}; only SQL {sorted(b)[:3]}"]
