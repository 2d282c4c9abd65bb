"""Every registered query against its SQL, on whole tables."""

import __spark_entry__ as driver
import pytest
from compare import connect, difference


@pytest.fixture(scope="module")
def con(tables_dir):
    return connect(tables_dir)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_matches_sql(spark, con, tables_dir, name):
    df = driver.queries()[name](spark, tables_dir)
    assert difference(df, con, driver.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(driver.queries()) - set(driver.oracle_sql())))
def test_runs_without_sql(spark, tables_dir, name):
    assert driver.queries()[name](spark, tables_dir).count() > 0


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["source", "category", "label", "count", "lower", "upper"]
    assert df.count() == 10


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
