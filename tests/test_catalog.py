"""Every registered query against its SQL on DuckDB, and the driver contract."""

import pytest

import __spark_entry__
from broadsheet.catalog import QUERIES, SQL
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    problem, _ = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert problem is None


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_no_case_folded_duplicates():
    assert len({n.lower() for n in QUERIES}) == len(QUERIES)
