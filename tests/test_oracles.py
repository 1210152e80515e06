"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from framespan.plans import checks
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(checks.QUERIES))
def test_query(spark, con, name):
    fn = checks.QUERIES[name]
    if name not in checks.ORACLES:
        assert fn(spark, SF).count() > 0
        return
    ok, note = compare(spark, con, SF, fn, checks.ORACLES[name])
    assert ok, note
