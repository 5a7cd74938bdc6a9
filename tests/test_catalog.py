"""Every catalogue query against its SQL."""

import pytest
from oracle import FOLDER, check, connect

from graphloom import catalog


@pytest.fixture(scope="module")
def duck():
    return connect()


@pytest.mark.parametrize("name", [*catalog.CATALOG, *catalog.QUADS])
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
    else:
        check(df, sql, duck)


def test_star_is_one_scan(spark):
    text = catalog.engine(spark, FOLDER).explain("SELECT ?a ?b WHERE { ?o :o_totalprice ?a ; :o_orderstatus ?b . FILTER(?a > 400000) }")
    assert text.count("ReadSchema") == 1 and "Join" not in text
    assert "GreaterThan(o_totalprice,400000.0)" in text and "o_orderpriority" not in text


#: Queries in which every row of one side meets every row of the other: disjoint patterns, constants, unbound shared variables.
PRODUCTS = {"optional_disjoint", "compat_join", "compat_optional", "minus_nullable", "optional_exists", "exists_disjoint", "values_undef", "subselect_scope", "bsbm_like_q2", "bsbm_like_q5", "bsbm_like_q7", "bi_like_q6"}


def test_joins_are_equations(spark):
    """Without broadcasts no other query is planned as nested loops."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = {n: f(spark, FOLDER)._jdf.queryExecution().executedPlan().toString() for n, f in catalog.queries().items() if n in catalog.CATALOG}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert {n for n, t in plans.items() if "CartesianProduct" in t or "NestedLoop" in t} <= PRODUCTS
    assert plans["bi_like_q5"].count("FileScan") <= 6
