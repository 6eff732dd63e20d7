"""Every query with SQL gives the same rows as DuckDB."""

import pytest

from brightfield import catalog
from tests.conftest import SF
from tests.oracle import check

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    check(spark, catalog.queries()[name], SQL[name], SF)


def test_names_are_known():
    assert set(SQL) <= set(catalog.queries()) and catalog.FLAGSHIP in catalog.queries()
