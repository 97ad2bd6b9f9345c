"""Every registered query against its SQL, over the whole small tables."""

import pytest

import __spark_entry__ as entry
from checks.queries import REGISTRY
from tests.compare import database, difference

QUERIES, SQL = entry.queries(), entry.oracle_sql()
SALES = sorted(REGISTRY)


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


def test_every_query_has_sql():
    assert not set(SALES) - set(SQL)
    assert not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", SALES)
def test_query(name, spark, sf_dir, con):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert len(got)
    assert difference(got, con.execute(SQL[name]).df()) == ""


@pytest.mark.parametrize("name, keys", [("sort_by_week", ["week", "dept", "type"]), ("sort_by_key", ["h2"]),
                                        ("sort_period_labels", ["label_order", "dept", "type"])])
def test_sorts_are_in_order(name, keys, spark, sf_dir):
    got = [tuple(row[k] for k in keys) for row in QUERIES[name](spark, sf_dir).collect()]
    assert got == sorted(got)


def test_difference_sees_changes(con):
    base = con.execute("SELECT 1 AS a, 0.5 AS b UNION ALL SELECT 2, NULL").df()
    other = con.execute("SELECT 1 AS a, 0.5 AS b UNION ALL SELECT 2, 0.25").df()
    assert difference(base, base.iloc[::-1]) == ""
    assert "rows differ" in difference(base, other)
    assert "rows" in difference(base, base.iloc[:1])
    assert "columns" in difference(base, base.rename(columns={"a": "c"}))
