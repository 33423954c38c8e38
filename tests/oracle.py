"""Compare a query with its SQL on DuckDB: same columns, same number of rows, same values whatever the order."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def plain(value):
    """A value in a form that both engines share; floats keep all their digits."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float, Decimal)):
        return float(value) + 0.0
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    return value


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(v) for v in row) for row in df.select(*names).collect())


def duck_rows(db, sql: str) -> tuple[list[str], Counter]:
    result = db.execute(sql)
    names = [c[0] for c in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = Counter(tuple(plain(row[i]) for i in order) for row in result.fetchall())
    return [names[i] for i in order], rows


def difference(df, db, sql: str) -> str | None:
    """None when both agree, else what differs."""
    spark_names, left = spark_rows(df)
    duck_names, right = duck_rows(db, sql)
    if spark_names != duck_names:
        return f"columns {spark_names} and {duck_names}"
    if left != right:
        extra, missing = left - right, right - left
        return (
            f"{sum(left.values())} and {sum(right.values())} rows; only Spark {sum(extra.values())}: "
            f"{list(extra)[:3]}; only SQL {sum(missing.values())}: {list(missing)[:3]}"
        )
    return None
