"""Run a named query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

from lociframe.plans import catalog

DATA = Path("/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connection(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/sf{sf}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_cell(r[i]) for i in order] for r in rows), key=repr)


def compare(spark, name: str, sf: str = "0.001") -> None:
    df = catalog.QUERIES[name](spark, f"{DATA}/sf{sf}")
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalog.ORACLES:
        return
    con = connection(sf)
    columns = [d[0] for d in con.execute("DESCRIBE " + catalog.ORACLES[name]).fetchall()]
    expected = _rows(columns, con.execute(catalog.ORACLES[name]).fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert g == e, (name, g, e)
