import pytest

from chainalerts.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import SF


def test_registered():
    import __spark_entry__

    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_like_sql(spark, name):
    from tools.check import compare, connect

    good, message = compare(spark, connect(SF), SF, name)
    assert good, message
