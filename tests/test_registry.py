"""Every registered query against its DuckDB oracle at sf0.001, plus the entry point."""

import pytest

import __spark_entry__ as E
from quire.plans.catalog import QUERIES
from oracle_check import duck, frame_digest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    got = frame_digest(E.queries()[name](spark, SF).toPandas())
    sql = E.oracle_sql().get(name)
    if sql is None:
        pytest.skip("rows-only query")
    want = frame_digest(con.sql(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[2] == want[2]


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns[0] == "item_id" and "combined_score" in df.columns
    assert df.where("combined_score is not null").count() > 0
