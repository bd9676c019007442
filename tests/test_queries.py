import pytest

import __spark_entry__ as entry
from tests.oracle import same
from veilwork.plans import compliance, detection

SQL = detection.SQL | compliance.SQL
ALL = detection.QUERIES | compliance.QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, data, name):
    same(spark, data, ALL[name], SQL[name])


def test_entry_and_registry(spark, data):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["lang", "emails", "documents"]


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert ALL[name](spark, data).schema is not None
    ALL[name](spark, data).write.format("noop").mode("overwrite").save()
