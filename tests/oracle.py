"""Rows of a query and of its SQL, in a form that can be compared."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def connection(folder=SF):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def shown(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(shown(r[i]) for i in order) for r in rows), key=repr)


def same(spark, query, sql, folder=SF):
    df = query(spark, folder)
    found = connection(folder).sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(found.columns, found.fetchall())
