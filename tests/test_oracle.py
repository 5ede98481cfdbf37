"""Every catalogue key against its DuckDB oracle on the sf0.001 tables."""

import duckdb
import pytest

import __spark_entry__ as E
from comparo.catalog import QUERIES
from comparo.checks.compare import TABLES, compare

KEYS = sorted(QUERIES)


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


def test_every_key_has_an_oracle():
    assert set(QUERIES) <= set(E.oracle_sql()) and set(QUERIES) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, sf_small, key):
    ok, msg, _ = compare(spark, con, key, E.queries()[key], E.oracle_sql()[key], sf_small)
    assert ok, msg
