"""Registered corpus queries against their SQL at the smallest scale."""

import pytest

from oracle_check import duck, frame_digest
from quire.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    got = frame_digest(QUERIES[name](spark, SF).toPandas())
    want = frame_digest(duck(SF).sql(ORACLES[name]).df())
    assert got[:3] == want[:3]
