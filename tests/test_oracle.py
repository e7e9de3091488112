"""Every core query with SQL gives what DuckDB gives, at the smallest size."""

from __future__ import annotations

import pytest

from convmem import registry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    said = compare(spark, con, name, registry.QUERIES[name], registry.ORACLE_SQL.get(name), SF)
    assert said.startswith(("equal", "rows")), said
