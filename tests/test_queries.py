"""Every registered query against the oracle's SQL on the same files."""

from __future__ import annotations

import pytest
from oracle import DATA, assert_same

from tessera.plans import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(name, spark, duck):
    assert_same(QUERIES[name](spark, DATA), duck, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_oracle(name, spark):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_names_match():
    assert set(ORACLE) <= set(QUERIES)
