"""Comparing a query with its SQL form in DuckDB, without regard to order."""

import glob
import os

import duckdb


def canonical(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(canonical(x) for x in v)
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=str)


def connection(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def compare(spark, folder, query, sql):
    df = query(spark, folder)
    ours = table(df.columns, [tuple(r) for r in df.collect()])
    rel = connection(folder).sql(sql)
    columns = rel.columns
    theirs = table(columns, rel.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert ours == theirs
