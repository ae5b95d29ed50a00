"""Compare a query with its SQL twin: same columns, same rows, order ignored."""

from __future__ import annotations

import glob
import os
from collections import Counter
from decimal import Decimal

import duckdb

TESTDATA = "/root/testdata"


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return f"{value:f}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> str | None:
    """None if equal, else a short account of the difference."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    wanted = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = rows_of(df.columns, df.collect())
    if got == wanted:
        return None
    missing = list((wanted - got).elements())[:3]
    extra = list((got - wanted).elements())[:3]
    return f"rows {sum(got.values())} vs {sum(wanted.values())}; only in SQL {missing}; only in Spark {extra}"[:1500]
