"""Every registered query against its SQL, or against its declared shape."""

from __future__ import annotations

import pytest
from compare import assert_same_rows

from fieldloom.plans import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    assert_same_rows(catalog.queries()[name](spark, sf_dir), duck.execute(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
