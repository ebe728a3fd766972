"""Runs a registered query and its SQL over the same tables and compares all rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def data_folder(sf: str) -> str:
    return os.path.join(os.environ.get("TEST_DATA", "/root/testdata"), f"sf{sf}")


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value + 0.0:.9g}" if value else "0"
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


def _kind(value) -> str:
    return type(value).__name__


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(
        tuple(_plain(r[i]) for i in order) for r in data
    ), {columns[i]: {_kind(r[i]) for r in data if r[i] is not None} for i in order}


def compare(spark, con, folder, fn, sql):
    df = fn(spark, folder)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows(names, cursor.fetchall())
    return ours, theirs
