"""Run a query on Spark and its SQL on DuckDB and compare all rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        p = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


def key(row):
    return tuple((v is None, str(type(v)), v) for v in row)


def compare(spark, con, sf_dir, name, query, sql):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols, name
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=key)
    assert got == want, (name, [p for p in zip(got, want) if p[0] != p[1]][:3], len(got), len(want))
    return len(got)
