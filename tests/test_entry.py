"""Every query with SQL gives the rows of its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from cellweave import catalog, catalog_records

QUERIES, SQL = {**catalog_records.queries(), **catalog.queries()}, {**catalog_records.oracle_sql(), **catalog.oracle_sql()}


@pytest.fixture(scope="module")
def con():
    from conftest import DATA

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("|".join(repr(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, data, name):
    df = QUERIES[name](spark, data)
    got = plain(df.columns, df.collect())
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == plain(names, cur.fetchall())


def test_entry_points(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_llm_package():
    root = os.path.dirname(catalog.__file__)
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, f)).read(), f
