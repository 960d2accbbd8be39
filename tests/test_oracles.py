"""Every registered query with SQL gives the same rows as DuckDB; every other one runs."""

import datetime
import importlib.util
import math

import duckdb
import pytest

from loomwright.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v) if isinstance(v, datetime.datetime | datetime.date) else repr(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, oracle, name):
    df = catalogue.queries()[name](spark, SF)
    got = df.collect()
    if name not in catalogue.oracle_sql():
        assert got
        return
    want = oracle.sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == sorted(df.columns)
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in got) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert importlib.util.find_spec("loomwright.llm") is None or "pipeline" in entry.queries()
