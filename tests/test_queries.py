"""Every registered query runs; those with a twin give its rows."""

from __future__ import annotations

import pytest

from brindle.plans import catalog

from .oracle import connect, rows_of_duck, rows_of_spark


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, sf_dir, con, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns, want = rows_of_duck(con, catalog.ORACLES[name])
    assert sorted(df.columns) == columns
    assert rows_of_spark(df) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
