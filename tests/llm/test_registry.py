"""The registered queries over the test tables, and those that SQL can state against it."""

from __future__ import annotations

import pytest
from oracle import DATA, assert_same

from tessera.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(name, spark, duck):
    assert_same(registry.queries()[name](spark, DATA), duck, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_a_row_for_each_document(name, spark):
    found = registry.queries()[name](spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert found.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert name.startswith("op4") or found.count() == docs.count()
