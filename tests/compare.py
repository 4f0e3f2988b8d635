"""Runs a query on Spark and its SQL on DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = """region nation customer supplier part orders lineitem events documents embeddings
pages benchmark labels conversations""".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(plain, key=repr)


def assert_same(df, con, sql):
    result = con.execute(sql)
    expected = rows_of([d[0] for d in result.description], result.fetchall())
    actual = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert actual[0] == expected[0]
    assert len(actual[1]) == len(expected[1]), (len(actual[1]), len(expected[1]))
    for mine, theirs in zip(actual[1], expected[1]):
        assert mine == theirs, f"\nspark {mine}\nduck  {theirs}"
