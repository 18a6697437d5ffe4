"""Compares a registered query with its SQL on the same tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for n in NAMES:
        p = f"{sf_dir}/{n}.parquet"
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{p}{'/**/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.itertuples(index=False)), key=repr)


def differ(spark_df, sql: str, con) -> str:
    a, b = spark_df.toPandas(), con.sql(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} {sorted(b.columns)}"
    x, y = rows(a), rows(b)
    if len(x) != len(y):
        return f"{len(x)} rows, {len(y)} by SQL"
    bad = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
    return f"{len(bad)} rows differ: {str(bad[0])[:400]}" if bad else ""
