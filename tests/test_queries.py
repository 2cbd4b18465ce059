import pytest
from compare import same

from stepframe.queries import ORACLE, QUERIES
from stepframe.registry import REGISTRY


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, small, duck, name):
    same(QUERIES[name](spark, small), duck.sql(ORACLE[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_every_operator_has_a_query():
    assert [op for op in REGISTRY if not any(q == op or q.startswith(op + "_") for q in QUERIES)] == []


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 100
    assert set(entry.oracle_sql()) <= set(entry.queries())
