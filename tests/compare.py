"""Compares a query with its SQL in DuckDB: row count, column names, and values in any order."""

from __future__ import annotations

import glob
import math
from datetime import date, datetime
from decimal import Decimal

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = path.rsplit("/", 1)[1][: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def cell(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, int):
        return f"{v}"
    if isinstance(v, (Decimal, datetime, date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return repr([cell(x) for x in v])
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return repr(v)


def table(columns: list[str], rows: list) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted("\x1f".join(cell(r[k]) for k in order) for r in rows)


def check(spark, con, query, sql: str, sf_dir: str) -> str:
    """'' if equal, else what differs."""
    df = query(spark, sf_dir)
    have = table(df.columns, [tuple(r) for r in df.collect()])
    got = con.execute(sql)
    want = table([d[0] for d in got.description], got.fetchall())
    if have[0] != want[0]:
        return f"columns {have[0]} and {want[0]}"
    if len(have[1]) != len(want[1]):
        return f"{len(have[1])} and {len(want[1])} rows"
    for a, b in zip(have[1], want[1], strict=True):
        if a != b:
            return f"{a!r} and {b!r}"
    return ""
