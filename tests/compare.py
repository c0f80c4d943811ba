"""Runs queries on the smallest tables and compares them with their SQL in DuckDB."""

import math
import os
from collections import Counter

BASE = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def rows_of_sql(sql):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(BASE):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{BASE}/{name}')")
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda n: found.columns[n])
    return [found.columns[n] for n in order], Counter(tuple(plain(r[n]) for n in order) for r in found.fetchall())


def rows_of_query(spark, query):
    df = query(spark, BASE)
    names = sorted(df.columns)
    return names, Counter(tuple(plain(v) for v in r) for r in df.select(*names).collect())


def check(spark, module, name):
    """A query against its SQL; those without any are scored by tests of their own (see README)."""
    names, got = rows_of_query(spark, module.QUERIES[name])
    want_names, want = rows_of_sql(module.ORACLE[name])
    assert names == want_names
    assert got == want
