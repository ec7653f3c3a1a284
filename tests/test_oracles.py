"""Every query with SQL, against DuckDB over the same tables."""

import decimal
import math
import os

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from blockweave.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(table, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in table)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    found = catalog.queries()[name](spark, SF)
    got = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(found.columns)
    assert rows(found.collect(), found.columns) == rows(got.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_needs_the_llm_subpackage():
    for folder, _, files in os.walk(os.path.join(os.path.dirname(__file__), "..", "blockweave")):
        if f"{os.sep}llm" not in folder:
            for f in (f for f in files if f.endswith(".py")):
                assert "llm" not in open(os.path.join(folder, f)).read(), f
