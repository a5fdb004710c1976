"""Every query that has SQL gives the same rows in both engines."""

import pytest

from tests.compare import check, connect
from tidemark.plans import CATALOG

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if q.sql is not None])
def test_same_rows(name, spark, con):
    rows, difference = check(CATALOG[name], spark, con, FOLDER)
    assert difference is None
    assert rows >= 0


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CATALOG) <= set(entry.queries())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
