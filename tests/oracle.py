"""Runs registered queries beside their SQL twins and compares the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import pathlib
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{pathlib.Path(sf) / name}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.6f}"
    if isinstance(value, int):
        return f"{value}"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def spark_rows(df):
    found = df.collect()
    return df.columns, rows_of(df.columns, found)


def duck_rows(con, sql):
    found = con.sql(sql)
    return found.columns, rows_of(found.columns, found.fetchall())


def compare(spark, sf, con, name, function, sql):
    """(ok, message, seconds)"""
    start = time.time()
    columns, got = spark_rows(function(spark, sf))
    seconds = time.time() - start
    if sql is None:
        return True, f"rows={len(got)}", seconds
    want_columns, want = duck_rows(con, sql)
    if sorted(columns) != sorted(want_columns):
        return False, f"columns {sorted(columns)} != {sorted(want_columns)}", seconds
    if got != want:
        only_got = [r for r in got if r not in set(want)][:3]
        only_want = [r for r in want if r not in set(got)][:3]
        return False, f"rows {len(got)} vs {len(want)}\n   spark {str(only_got)[:600]}\n   sql   {str(only_want)[:600]}", seconds
    return True, f"rows={len(got)}", seconds
