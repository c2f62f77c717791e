import pytest

from __spark_entry__ import entry, oracle_sql, queries
from registry.oracle import all_oracles
from registry.queries import all_queries
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
# They run for a minute; tests of the streams cover them, tools/check.py these queries.
SLOW = {"stream_notifications", "stream_resumed", "stream_keyed_state"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracles())
    assert set(all_queries()) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 640


@pytest.mark.parametrize("name", sorted(set(all_queries()) - SLOW))
def test_query_equals_sql(spark, con, name):
    good, message = compare(spark, con, SF, name)
    assert good, message
