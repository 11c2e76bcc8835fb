"""Every registered query against its SQL on the small tables; no plan has a cross join."""

import pytest
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from pickwell.plans.oracles import ORACLES
from pickwell.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert compare(spark, duck, SF, QUERIES[name], ORACLES[name]) is None


def test_compare_notices_a_wrong_value(spark, duck):
    sql = oracle_sql()["has_users"].replace("IN (SELECT id", "NOT IN (SELECT id")
    assert compare(spark, duck, SF, queries()["has_users"], sql) is not None


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns == ["user", "rank", "item", "score"]
    assert rows.groupBy("user").count().where("count != 10").isEmpty()
