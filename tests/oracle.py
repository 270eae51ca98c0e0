"""Holds a query's rows against DuckDB's."""

from __future__ import annotations

import datetime
import decimal

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(v: object) -> object:
    if isinstance(v, decimal.Decimal):
        return str(int(v)) if v == int(v) else str(v.normalize())
    if isinstance(v, float):
        return repr(int(v)) if v == int(v) else repr(v)
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def assert_same(df: DataFrame, sql: str, sf_dir: str) -> None:
    names = sorted(df.columns)
    ours = sorted(str([plain(r[k]) for k in names]) for r in df.collect())
    got = connect(sf_dir).execute(sql)
    theirs_names = [d[0] for d in got.description]
    assert sorted(theirs_names) == names
    theirs = sorted(str([plain(r[theirs_names.index(k)]) for k in names]) for r in got.fetchall())
    assert ours == theirs
