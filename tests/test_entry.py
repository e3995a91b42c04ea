import pytest

import __spark_entry__ as entry_module
from checks import compare, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return compare.database(SF)


def test_entry(spark):
    extra = sum(i % 13 in (0, 6, 7, 8, 9) for i in range(200))
    assert entry_module.entry(spark).count() == 200 + extra


def test_registry_is_consistent():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, db, name):
    ok, note = compare.compare(spark, db, SF, name)
    assert ok, note
