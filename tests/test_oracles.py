import pytest
from compare import assert_same

from tessera.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLES[name], SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
