"""Every registered query against DuckDB, or that it runs where SQL has no form."""

import os

import pytest

from sparkloom import catalogue
from tests.oracle import connect, difference

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    query = catalogue.queries()[name]
    if name in SQL:
        assert difference(spark, con, query, SQL[name], SF) is None
    else:
        assert query(spark, SF).count() > 0
