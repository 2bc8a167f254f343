from __future__ import annotations

import pytest

from codeloom.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(same_as_oracle, name):
    same_as_oracle(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0
