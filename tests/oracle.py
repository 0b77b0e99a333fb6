"""Runs a query in Spark and its SQL in DuckDB over the same tables, and compares the rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def database(sf: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def compare(spark, query, sql: str, sf: str = SF) -> None:
    df = query(spark, sf)
    with database(sf) as con:
        relation = con.execute(sql)
        names = [c[0] for c in relation.description]
        expected = relation.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = [df.columns.index(n) for n in names]
    got = Counter(tuple(plain(r[i]) for i in order) for r in df.collect())
    want = Counter(tuple(plain(v) for v in r) for r in expected)
    assert got == want, f"missing {list((want - got).items())[:3]}, extra {list((got - want).items())[:3]}"
