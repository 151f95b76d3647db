import pytest
from conftest import SF, assert_same

from quarrystone.plans import catalogue, document_tables, estate_tables, gathered_tables, generated_tables, more_tables, source_tables, summary_tables, tables  # noqa: F401


#: Queries that SQL can't express; their own tests hold them against examples traced by hand.
WITHOUT_SQL = {"recursive_chunks"}


def test_queries_without_sql_are_stated():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert_same(df, duck.sql(catalogue.ORACLES[name]))


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
