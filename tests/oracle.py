"""Compares a query with its SQL on the same Parquet files."""

import glob
import math
import os

import duckdb


def views(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def _cell(x):
    if x is None:
        return None
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 4) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(_cell(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, _cell(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return _cell(x.asDict())
    if type(x).__name__ == "Decimal":
        return round(float(x), 4)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in data), key=repr)


def compare(df, sql, con):
    rel = con.sql(sql)
    names = list(rel.columns)
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    mine, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, rel.fetchall())
    assert len(mine) == len(theirs), (len(mine), len(theirs), mine[:2], theirs[:2])
    for a, b in zip(mine, theirs):
        assert a == b, (a, b)
    return len(mine)
