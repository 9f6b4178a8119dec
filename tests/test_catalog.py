"""Every named query beside its SQL; those without SQL run and give rows."""

from __future__ import annotations

import pytest

from quern.plans import catalog
from tests.oracle import difference


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, data, name):
    assert not difference(catalog.queries()[name](spark, data), data, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, data, name):
    df = catalog.queries()[name](spark, data)
    assert df.columns
    assert df.count() >= 0
