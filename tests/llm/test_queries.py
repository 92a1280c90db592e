"""The training-data queries against their SQL."""

import pytest

import __spark_entry__ as contract
from cartrail.llm.queries import ORACLE
from check_oracle import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(contract.LLM_QUERIES))
def test_query_matches_sql(spark, name):
    ok, note = compare(spark, SMALL, name)
    assert ok, note


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(contract.LLM_QUERIES)
