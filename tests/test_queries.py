"""Every query against its SQL twin on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry_point

duckdb = pytest.importorskip("duckdb")
TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")

QUERIES, TWINS = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for file in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


def ordered(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


def test_twins_belong_to_queries():
    assert set(TWINS) <= set(QUERIES)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_twin(spark, database, name):
    got = QUERIES[name](spark, TABLES)
    cursor = database.execute(TWINS[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    assert ordered(got.collect(), got.columns) == ordered(cursor.fetchall(), columns)


def test_every_query_of_the_library_has_a_twin():
    from corpusloom.plans.queries import all_queries

    assert set(all_queries()) <= set(TWINS)
