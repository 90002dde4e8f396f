"""Every registered query against its SQL."""

import os

import pytest

from corpusloom import catalog
from tests.oracle import connect, difference

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    assert difference(spark, con, name, SF_DIR) is None


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
