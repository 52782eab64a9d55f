import pytest
from oracle import connect, differences

from tidemark.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_oracle(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLE_SQL[name]) == ""
