"""Every registered query against its SQL, and the entry point's contract."""

from __future__ import annotations

import pytest

from arborframe.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_agrees_with_sql(spark, sf_dir, agree, name):
    agree(registry.QUERIES[name](spark, sf_dir), registry.SQL[name])


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
