"""Rows of a query against those of DuckDB SQL, as sorted tuples in the order of the columns' names."""

import math

import duckdb

from tests.conftest import TABLES

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, sql: str, folder: str) -> None:
    with duckdb.connect() as con:
        for t in TABLES:
            con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
        want = con.sql(sql)
        names, types, rows = want.columns, dict(zip(want.columns, map(str, want.types), strict=True)), want.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert {c: KINDS.get(t, t) for c, t in df.dtypes} == {c: types[c] for c in df.columns}
    assert rows_of(df.columns, df.collect()) == rows_of(names, rows)
