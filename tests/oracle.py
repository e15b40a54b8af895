"""Runs a query and its SQL side by side and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in by], sorted((tuple(plain(r[i]) for i in by) for r in rows), key=repr)


def compare(spark, run, sql, sf_dir):
    """None, or what differs."""
    df = run(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    theirs = rows_of([c[0] for c in cur.description], cur.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} and {len(theirs[1])} rows"
    bad = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b and not all(x == y or isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) <= 2e-6 * max(1, abs(y)) for x, y in zip(a, b))]
    return f"{len(bad)} of {len(ours[1])} rows differ: {bad[:2]}" if bad else None
