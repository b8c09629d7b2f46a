"""Spark results against DuckDB's on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb

TABLES = "/root/testdata"


def oracle(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(_plain, v))
    return v.isoformat(" ") if hasattr(v, "isoformat") else v


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def both(spark, con, query, sql: str, sf_dir: str):
    """(column names and rows of Spark, those of DuckDB)"""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return (sorted(df.columns), got), (sorted(names), rows_of(names, cur.fetchall()))
