"""Rows of a Spark query beside those of its SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(value):
    """A value as both engines would have it."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in df.select(*(f"`{n}`" for n in names)).collect())


def duck_rows(folder: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("SET threads = 2; SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in got.fetchall())


def difference(df, folder: str, sql: str) -> str:
    """What differs, or an empty text."""
    a_names, a = spark_rows(df)
    b_names, b = duck_rows(folder, sql)
    if a_names != b_names:
        return f"columns {a_names} and {b_names}"
    if a != b:
        return f"{sum(a.values())} and {sum(b.values())} rows; only Spark: {list((a - b).elements())[:3]}; only SQL: {list((b - a).elements())[:3]}"
    return ""
