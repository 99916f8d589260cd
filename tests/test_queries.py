import pytest
from oracle import SMALL, connect, same

from textlake import catalog
from textlake.plans import queries  # noqa: F401  fills the catalog


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_its_sql(spark, con, name):
    same(catalog.QUERIES[name](spark, SMALL), catalog.ORACLE_SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0
