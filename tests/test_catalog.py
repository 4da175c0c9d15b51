"""Every registered query on the smallest tables, against its SQL where it has one."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from tests.check_oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the generated tables")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", contract.oracle_sql())
def test_query_agrees_with_sql(spark, connection, name):
    assert compare(spark, connection, SF_DIR, name) is None


@pytest.mark.parametrize("name", sorted(contract.queries().keys() - contract.oracle_sql().keys()))
def test_query_gives_rows(spark, name):
    assert contract.queries()[name](spark, SF_DIR).count() > 0


def test_every_oracle_has_a_query():
    assert contract.oracle_sql().keys() <= contract.queries().keys()


def test_entry(spark):
    assert contract.entry(spark).columns == ["label", "n", "pct", "bug_type"]
