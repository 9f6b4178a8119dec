"""Queries of the subpackage beside their SQL."""

from __future__ import annotations

import pytest

from quern.llm import registry
from tests.oracle import difference


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, data, name):
    assert not difference(registry.queries()[name](spark, data), data, registry.oracle_sql()[name])


def test_entry_point_offers_all():
    import __spark_entry__

    assert {*registry.queries(), "pipeline"} <= set(__spark_entry__.queries())
