"""Runs a query's SQL in DuckDB over the same files and compares rows."""

import os

import duckdb

DATA = os.environ.get("KOLONNA_TESTDATA", "/root/testdata")


def connect(folder):
    db = duckdb.connect()
    for file in os.listdir(folder):
        path = f"{folder}/{file}"
        db.execute(f"create view {file.split('.')[0]} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return db


def same(db, frame, sql):
    columns = sorted(frame.columns)
    got = sorted(tuple(repr(r[c]) for c in columns) for r in frame.collect())
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(repr(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want
