"""Runs queries against their SQL twins in DuckDB."""

import math
import re

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, int):
        return x
    return re.sub(r"\.0$", "", str(x)) if not isinstance(x, str) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr), sorted(columns)


def same(df, con, sql):
    """None if the frame and the SQL agree, else what differs."""
    return compare(df.columns, df.collect(), con, sql)


def compare(columns, rows, con, sql):
    """The same for rows that are already here."""
    got, names = rows_of(columns, [tuple(r) for r in rows])
    cur = con.execute(sql)
    want, other = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != other:
        return f"columns {names} and {other}"
    if got != want:
        k = next((i for i, (a, b) in enumerate(zip(got, want)) if a != b), min(len(got), len(want)))
        return f"{len(got)} and {len(want)} rows; first difference {got[k:k+1]} and {want[k:k+1]}"
    return None
