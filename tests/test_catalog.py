"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as driver
from catalog.compare import difference
from catalog.oracle import statements
from catalog.queries import registered

SF = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")
FITTED = {"huber_regression", "training_run"}


def test_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries()) and set(registered()) <= set(driver.queries())
    assert set(registered()) == set(statements())
    table = driver.entry(spark)
    assert table.count() > 0 and "rolling_std_50" in table.columns


def test_contract_without_the_corpus_operators(monkeypatch):
    monkeypatch.setattr("importlib.util.find_spec", lambda name: None)
    assert set(driver.queries()) == set(registered()) and set(driver.oracle_sql()) == set(statements())


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not there")
@pytest.mark.parametrize("name", [name for name in registered() if name not in FITTED])
def test_query_agrees_with_sql(spark, name):
    assert difference(spark, SF, name) is None


@pytest.mark.skipif("sf0.001" not in SF or not os.path.isdir(SF), reason="needs the smallest tables")
@pytest.mark.parametrize("name", sorted(FITTED))
def test_series_too_short_to_train_on(spark, name):
    """At this size no series fills a 50-row window. The larger tables do train."""
    with pytest.raises(ValueError, match="no training rows"):
        registered()[name](spark, SF)
