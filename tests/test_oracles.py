"""Registered queries against their SQL at the smallest scale."""

import pytest
from compare import difference, duck

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    res = con.execute(ORACLES[name])
    assert difference(df.columns, df.collect(), [d[0] for d in res.description], res.fetchall()) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_flagship_keeps_every_household(spark, sf):
    n = spark.read.parquet(f"{sf}/customer.parquet").count()
    assert entry.entry(spark).count() == n
