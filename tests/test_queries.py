"""Every query of the library itself against its SQL on the smallest data; those of optional subpackages have tests of their own."""

import sys

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
OWN = [query.__name__ for query in entry._QUERIES]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(OWN) == set(entry._own_sql())
    assert set(OWN) <= set(entry.queries())


def test_own_queries_stay_without_optional_modules(monkeypatch):
    # An entry of None makes every import of that module an ImportError.
    monkeypatch.setitem(sys.modules, "chainage.llm", None)
    assert list(entry.queries()) == OWN
    assert set(entry.oracle_sql()) == set(OWN)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, name, SF) is None
