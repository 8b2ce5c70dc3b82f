import os

import pytest

from tests.compare import differences, duck

import __spark_entry__ as contract
from listwright.catalog import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


def test_every_check_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def plan_problems(frame, name):
    """Operators that would not hold at scale, and Python where none is needed."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    barred = ("CartesianProduct", "NestedLoopJoin", "Window ", "Window [")
    found = [operator for operator in barred if operator in plan]
    if ("Python" in plan or "MapInPandas" in plan) != (name == "scorer_calls"):
        found.append("Python")
    return found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    frame = contract.queries()[name](spark, SF)
    assert not plan_problems(frame, name)
    check = contract.oracle_sql().get(name)
    if check is None:
        assert frame.count() > 0
    else:
        assert differences(frame, connection, check) is None
