"""Hold a Spark result against DuckDB's, as sets of rows with columns in order of name."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, sf_dir: str, sql: str) -> list:
    columns, expected = oracle(sf_dir, sql)
    assert sorted(columns) == sorted(df.columns), (sorted(columns), sorted(df.columns))
    a, b = rows_of(df.columns, df.collect()), rows_of(columns, expected)
    if len(a) != len(b):
        return [("rows", len(a), len(b))] + list(zip(a[:2], b[:2]))
    return [(x, y) for x, y in zip(a, b, strict=True) if not same(x, y)]


def same(x, y) -> bool:
    """Values on a rounding boundary may differ in the last place that is kept."""
    for p, q in zip(x, y, strict=True):
        if isinstance(p, tuple) and isinstance(q, tuple):
            if len(p) != len(q) or not same(p, q):
                return False
        elif p != q and not (isinstance(p, (int, float)) and isinstance(q, (int, float)) and math.isclose(p, q, rel_tol=1e-9, abs_tol=1.1e-5)):
            return False
    return True
