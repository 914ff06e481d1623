"""Holds a query against its SQL in DuckDB."""

import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        path = f"{sf}/{name}/*.parquet" if os.path.isdir(f"{sf}/{name}") else f"{sf}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(v[i] for i in order) for v in values), key=lambda r: tuple((x is not None, str(x)) for x in r))


def both(spark, con, sf, query, sql):
    df = query(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    return got, want
