"""Registered queries of the text operators against their SQL on the smallest tables."""

from __future__ import annotations

import pytest

from framespan.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, con, name):
    ok, note = compare(spark, con, SF, QUERIES[name], ORACLES[name])
    assert ok, note


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
