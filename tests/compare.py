"""Row comparison of a Spark query with its SQL in DuckDB."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 6)
    return x


def rows(found):
    return sorted((tuple(value(x) for x in r) for r in found), key=repr)


def assert_same(df, con, sql):
    cols = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    at = [list(rel.columns).index(c) for c in cols]
    kinds = dict(df.dtypes)
    assert {c: TYPES.get(kinds[c]) for c in cols} == {c: str(rel.types[i]) for c, i in zip(cols, at)}
    got = rows([tuple(r[c] for c in cols) for r in df.collect()])
    want = rows([tuple(r[i] for i in at) for r in rel.fetchall()])
    assert got == want
