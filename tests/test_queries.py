"""Every query against its SQL on DuckDB, and rows for those that SQL can't express."""

from __future__ import annotations

import pytest

from tessera.plans import ORACLES, QUERIES

from .compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, duck, name):
    found = compare(spark, SF, QUERIES[name], ORACLES[name], duck)
    assert found == "", found


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
