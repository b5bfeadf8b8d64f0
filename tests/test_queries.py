"""Registered queries against DuckDB on the smallest tables; decorations must trigger."""

import hashlib
import os

import duckdb
import pytest

from foliosmith.plans import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in queries.TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(hashlib.md5(repr([r[k] for k in order]).encode()).hexdigest() for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, want.fetchall())


def test_decorations_trigger(spark):
    assert queries.running_chrome(spark, DATA).count() > 0
    assert queries.section_boundaries(spark, DATA).filter("appendix_start is not null").count() > 0
    sources = {r["source"] for r in queries.source_chain(spark, DATA).select("source").distinct().collect()}
    assert {"s2-arxiv-id", "arxiv-export", "s2-title", "best-effort", "not-citable"} <= sources


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
