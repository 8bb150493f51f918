"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{v:.9g}"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return str({k: norm(v[k]) for k in sorted(v)})
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def connection(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def compare(df, sql, sf_dir):
    names = sorted(df.columns)
    got = sorted([norm(r[n]) for n in names] for r in df.collect())
    cursor = connection(sf_dir).execute(sql)
    at = {d[0]: k for k, d in enumerate(cursor.description)}
    assert sorted(at) == names
    want = sorted([norm(r[at[n]]) for n in names] for r in cursor.fetchall())
    assert got == want
