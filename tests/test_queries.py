"""Registered queries against their DuckDB equivalents, and invariants of the paragraph table."""

import math

import duckdb
import pytest

from tonemill.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def cell(v):
    if hasattr(v, "tolist") and not isinstance(v, str):
        v = v.tolist()
    if isinstance(v, bool | str) or v is None:
        return str(v)
    if isinstance(v, int | float):
        return "None" if isinstance(v, float) and math.isnan(v) else f"{float(v):.6f}".replace("-0.000000", "0.000000")
    return str(v)


def rows(columns, data):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in at) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    got = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, got.fetchall())


def test_paragraph_table(spark, sf):
    rows = catalog.queries()["paragraph_table"](spark, sf).collect()
    by = {}
    for r in rows:
        assert r["word_count"] >= 50
        by.setdefault(r["doc_id"], []).append(r["paragraph_id"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
