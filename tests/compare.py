"""Rows of a query and of its SQL in DuckDB, in one comparable form."""

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata"


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{sf}/{t}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, query, sql: str, sf: str = "sf0.01"):
    """(columns equal, rows only in Spark, rows only in DuckDB, number of rows)."""
    df = query(spark, f"{DATA}/{sf}")
    got = rows_of(df.columns, df.collect())
    result = duck(sf).sql(sql)
    want = rows_of(result.columns, result.fetchall())
    from collections import Counter

    a, b = Counter(map(repr, got)), Counter(map(repr, want))
    return sorted(df.columns) == sorted(result.columns), list((a - b))[:2], list((b - a))[:2], len(got)
