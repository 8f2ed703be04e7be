"""The corpus queries that have a SQL twin."""

import oracle
import pytest

from terracover.llm.oracles import ORACLES
from terracover.llm.queries import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert oracle.same(queries()[name](spark, SF), oracle.connect(SF), ORACLES[name]) is None
