"""The registered queries against SQL over whole small tables, and that all of them run."""

from __future__ import annotations

import pytest
from helpers import SMALL, same_rows

from packlens.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(name, spark, duck):
    same_rows(registry.QUERIES[name](spark, SMALL), duck, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(name, spark):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_ten_operators():
    numbers = sorted(int(name[2:].split("_")[0]) for name in registry.QUERIES)
    assert numbers == list(range(1, 11))
