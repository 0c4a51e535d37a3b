"""Spark rows against the rows that DuckDB gives for the same query's SQL."""

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def shown(value):
    return f"{float(value):.9g}" if isinstance(value, float | decimal.Decimal) else str(value)


def same_rows(spark, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = query(spark, SF)
    names = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == names
    got = sorted(tuple(shown(r[c]) for c in names) for r in df.collect())
    at = [rel.columns.index(c) for c in names]
    assert got == sorted(tuple(shown(r[k]) for k in at) for r in rel.fetchall())
