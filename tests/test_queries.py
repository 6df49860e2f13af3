"""Every registered query against its SQL, over whole tables."""

from __future__ import annotations

import pytest
from conftest import DATA

from rollbook import registered


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_query_equals_sql(spark, duck, canonical, name):
    assert canonical(registered.QUERIES[name](spark, DATA).toPandas()) == canonical(duck.sql(registered.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registered.QUERIES) - set(registered.ORACLES)))
def test_query_runs(spark, name):
    assert registered.QUERIES[name](spark, DATA).count() > 0


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
