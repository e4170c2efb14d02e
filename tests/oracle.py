"""Compares a registered query with its SQL in DuckDB over the same Parquet tables."""

import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.9g}"
    return str(x)


def differences(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    found = con.execute(sql)
    assert names == sorted(c[0] for c in found.description)
    at = {c[0]: i for i, c in enumerate(found.description)}
    theirs = sorted(tuple(plain(r[at[n]]) for n in names) for r in found.fetchall())
    ours = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    return [(a, b) for a, b in zip(ours, theirs, strict=False) if a != b][:3] + ([("rows", len(ours), len(theirs))] if len(ours) != len(theirs) else [])
