"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import oracle
from answerloom.catalog import registry

REGISTERED = registry.registered()
SQL = {name: sql for name, (_, sql) in REGISTERED.items() if sql}
QUERIES = {name: query for name, (query, _) in REGISTERED.items()}


@pytest.fixture(scope="module")
def duck(data):
    if not os.path.isdir(data):
        pytest.skip("no test tables here")
    return oracle.connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    if name in SQL:
        assert oracle.compare(df, duck, SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r.scope for r in rows} == {"overall", "topic"}
    assert sum(r.support for r in rows if r.scope == "topic") == next(
        r.support for r in rows if r.scope == "overall"
    )
