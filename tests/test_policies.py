"""Row-level security in SQL: reads, writes, and who the caller is."""

import pytest

from docketry.operators.policies import Policies
from docketry.plans.base import Tables
from docketry.plans.tenancy import _as_office
from tests.conftest import SF


def test_writes_across_offices_fail(spark):
    mine = _as_office(Tables(spark, SF), 5)
    with pytest.raises(Exception, match="violates the policy of customer"):
        mine.insert("customer", "SELECT 1L, 'x', 6, 0.0D, 'y'").collect()
    with pytest.raises(Exception, match="violates the policy of customer"):
        mine.insert("customer", "SELECT 1L, 'x', CAST(NULL AS INT), 0.0D, 'y'").collect()
    with pytest.raises(Exception, match="violates the policy of customer"):
        mine.update("customer", {"c_nationkey": "6"}, "TRUE").collect()
    with pytest.raises(Exception, match="violates the policy of region"):
        mine.insert("region", "SELECT 9, 'x'").collect()
    before = spark.read.parquet(f"{SF}/customer.parquet").count()
    assert mine.delete("customer", "TRUE").where("c_nationkey = 5").count() == 0
    assert mine.delete("customer", "c_nationkey = 6").count() == before  # others' rows aren't there to delete
    assert mine.update("customer", {"c_nationkey": "6"}, "c_nationkey = 7").count() == before


def test_predicate_reaches_the_scan(spark):
    plan = _as_office(Tables(spark, SF), 5).select("SELECT c_name FROM customer")._jdf.queryExecution().toString()
    assert "EqualTo(c_nationkey,5)" in plan and "ReadSchema: struct<c_name:string,c_nationkey:int>" in plan


def test_sessions_are_apart(spark):
    t = Tables(spark, SF)
    one, two, nobody = _as_office(t, 5), _as_office(t, 6), _as_office(t, None, None)
    counts = [p.select("SELECT count(*) AS n FROM customer").first().n for p in (one, two, nobody)]
    assert counts[0] > 0 and counts[1] > 0 and counts[2] == 0 and nobody.select("SELECT * FROM part").count() == 0
    assert two.select("SELECT auth_office_id() AS o, auth_user_id() AS u").first() == (6, 1)
    assert not spark.catalog.tableExists("all_customer")
    assert nobody.select("SELECT * FROM lineitem").count() == 0


def test_null_is_no_match(spark):
    p = Policies(spark, {"orders": f"{SF}/orders.parquet"}, {"orders": "o_orderkey = auth_user_id()"}, None, 1)
    assert p.select("SELECT * FROM orders").count() == 0 and p.delete("orders", "TRUE").count() == spark.read.parquet(f"{SF}/orders.parquet").count()
