"""Every query with an oracle against DuckDB at the smallest size."""

import pytest

from quern.plans.registry import ORACLES, QUERIES
from tests.oracle import DATA, differences, duck

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle(spark, con, name):
    assert differences(QUERIES[name](spark, SF), ORACLES[name], con) == ""
