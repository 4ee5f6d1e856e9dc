"""Every registered query next to its SQL in DuckDB, on the smallest test corpus."""

import os

import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    from tools.check_oracles import TABLES

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    from tools.check_oracles import compare

    text, _, good = compare(
        spark, duck, SF_DIR, name, entry.queries()[name], entry.oracle_sql().get(name)
    )
    assert good, text


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
