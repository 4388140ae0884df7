"""Every query of the reference's operators against the SQL that is registered beside it."""

import pytest

from docketry.plans import registry
from tests.compare import connect, rows_of_spark, rows_of_sql
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, con, name):
    names, rows = rows_of_spark(registry.queries()[name](spark, SF))
    sql_names, sql_rows = rows_of_sql(con, registry.oracle_sql()[name])
    assert names == sql_names
    assert rows == sql_rows


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).columns
