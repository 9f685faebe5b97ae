import pytest

from tests.oracle import connection, differences
from tideline.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    bad, _ = differences(spark, name, SF, duck)
    assert bad is None


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["state", "reason", "runs", "oldest_started_at", "oldest_age_ms"]
    assert set(e.oracle_sql()) <= set(e.queries())
