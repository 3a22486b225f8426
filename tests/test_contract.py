"""Driver contract: registry, oracle coverage, smoke entry, oracle parity."""

import duckdb
import pytest

import __spark_entry__ as entry_mod
from reelstat import reports
from reelstat.sources.tables import TEST_TABLES
from tools.check_oracle import compare

SMALL = "/root/testdata/sf0.001"


def test_every_query_has_an_oracle():
    # the training-data operators have queries that SQL cannot express; their
    # own tests hold those against brute force
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())
    assert set(reports.names()) <= set(entry_mod.oracle_sql())


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.count() >= 1
    assert "revenue" in df.columns


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TEST_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(reports.names()))
def test_matches_oracle_sf0001(spark, duck, name):
    sdf = entry_mod.queries()[name](spark, SMALL).toPandas()
    odf = duck.execute(entry_mod.oracle_sql()[name]).df()
    assert compare(sdf, odf) == "OK"
