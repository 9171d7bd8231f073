"""Compare a query with its SQL in DuckDB: columns, kinds of types, and rows without order."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "long", "integer": "int", "smallint": "short", "tinyint": "byte", "varchar": "string", "hugeint": "huge"}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def differences(spark, sf: str, query, sql: str, con=None) -> str:
    """Empty if both agree."""
    df = query(spark, sf)
    con = con or connect(sf)
    rel = con.sql(sql)
    mine, theirs = sorted(df.columns), sorted(rel.columns)
    if mine != theirs:
        return f"columns {mine} against {theirs}"
    kinds = dict(df.dtypes)
    for c, t in zip(rel.columns, rel.types, strict=True):
        t = str(t).lower()
        have = {"bigint": "long", "int": "int"}.get(kinds[c], kinds[c])
        want = KINDS.get(t, t)
        if have != want and "[" not in t:
            return f"type of {c}: {have} against {want}"
    a = Counter(tuple(plain(r[c]) for c in mine) for r in df.select(*mine).collect())
    at = [rel.columns.index(c) for c in mine]
    b = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    if a != b:
        return f"{sum(a.values())} rows against {sum(b.values())}; only in one: {list((a - b).items())[:3]} against {list((b - a).items())[:3]}"
    return "" if a else "no rows"


def files(pattern: str) -> list[str]:
    return sorted(glob.glob(pattern))
