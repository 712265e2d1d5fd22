"""Compares a Spark result with DuckDB's for the same tables: names, types, values."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb

from millrace.sources.tables import TABLES

TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN", "float": "FLOAT"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p}/*.parquet' )" if os.path.isdir(p) else f"create view {t} as select * from read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


def difference(df, con, sql: str) -> str:
    """Empty if both agree."""
    got = df.collect()
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    types = {d[0]: str(d[1]) for d in res.description}
    want = res.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} against {names}"
    for c, t in df.dtypes:
        if TYPES.get(t, t) != types[c]:
            return f"type of {c}: {t} against {types[c]}"
    cols = sorted(names)
    a = sorted(tuple(plain(r[c]) for c in cols) for r in got)
    at = [names.index(c) for c in cols]
    b = sorted(tuple(plain(r[i]) for i in at) for r in want)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    return next((f"{x} against {y}" for x, y in zip(a, b, strict=True) if x != y), "")
