"""Compare a registered query with its SQL on the same tables."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x + 0.0:.9g}")
    if isinstance(x, int):
        return float(x) if abs(x) < 2 ** 53 else x
    return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, name, query, sql, sf):
    got = query(spark, sf)
    mine = rows(got.columns, got.collect())
    rel = con.sql(sql)
    theirs = rows(rel.columns, rel.fetchall())
    assert sorted(got.columns) == sorted(rel.columns), (name, got.columns, rel.columns)
    assert len(mine) == len(theirs), (name, len(mine), len(theirs), mine[:3], theirs[:3])
    for a, b in zip(mine, theirs):
        assert a == b, (name, a, b)
    return len(mine)
