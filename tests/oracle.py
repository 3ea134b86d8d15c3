"""Runs a query's SQL in DuckDB and compares it with the Spark rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def normal(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: str(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(value(r[i]) for i in at) for r in rows)


def same(frame, db, sql):
    got = normal(frame.columns, [tuple(r) for r in frame.collect()])
    found = db.execute(sql)
    want = normal([d[0] for d in found.description], found.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
