"""The corpus operators' queries against their SQL."""

from __future__ import annotations

import pytest

from lexigrove.llm.queries import oracle_sql, queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, name):
    compare(spark, queries()[name], oracle_sql()[name])
