"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from fleetlens.plans.catalog import QUERIES
from fleetlens.plans.oracle import ORACLE
from tests.check_oracle import connect, differences, type_differences


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(name, spark, sf, con):
    df = entry.queries()[name](spark, sf)
    got, want = df.toPandas(), con.sql(entry.oracle_sql()[name])
    assert len(got) > 0
    assert type_differences(df, want) is None
    assert differences(got, want.df()) is None


def test_entry(spark):
    assert entry.entry(spark).columns == [
        "qid", "user_id", "latitude", "longitude", "distance_meter"
    ]
