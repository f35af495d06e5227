"""Runs a query in Spark and its SQL in DuckDB and compares the rows, whatever their order."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if hasattr(value, "asDict"):
        return tuple((k, plain(v)) for k, v in value.asDict().items())
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir, f"{table}.parquet")
        if path.exists():
            con.execute(f"create view {table} as select * from read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, cursor.fetchall()


def rows_by_name(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple(plain(row[k]) for k in order) for row in rows)


def differences(spark_df, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows."""
    names, rows = duck_rows(sql, sf_dir)
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    ours, theirs = rows_by_name(spark_df.columns, [tuple(r) for r in spark_df.collect()]), rows_by_name(names, rows)
    if ours == theirs:
        return ""
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:3]}; only theirs {list((theirs - ours).items())[:3]}"
