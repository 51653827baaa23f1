import pytest

from rivulet.llm.queries import ORACLES, QUERIES

from ..oracle import differences


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_oracle(spark, sf, name):
    assert differences(spark, sf, QUERIES[name], ORACLES[name]) is None
