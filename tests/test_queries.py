import pytest

from gaugemill.plans.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, small, same, name):
    same(QUERIES[name](spark, small), ORACLE_SQL[name])


def test_every_query_has_sql(spark, small):
    assert set(QUERIES) == set(ORACLE_SQL)


def test_queries_about_differences_find_some(spark, small):
    for name in ("answers_differ", "reports_differ", "station_faults"):
        assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
