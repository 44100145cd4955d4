"""Every registered query against its SQL twin."""

import pytest

from oracle import compare, connect
from tripweave.plans.registry import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_a_twin():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLE[name], FOLDER) == ""


def test_entry_runs(spark):
    from __spark_entry__ import entry, oracle_sql, queries
    assert entry(spark).columns == ["weather_label", "hours", "avg_temperature_c"]
    assert oracle_sql().keys() <= queries().keys()
