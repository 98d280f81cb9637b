"""Each registered query of the catalogue against its SQL."""

import pytest
from prismora import catalog

from .oracle import connect, rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"
ENTRIES = catalog.entries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(k for k, (_, text) in ENTRIES.items() if text))
def test_query_equals_sql(spark, con, name):
    query, text = ENTRIES[name]
    df = query(spark, SF)
    expected, names = rows_of_sql(con, text)
    assert sorted(df.columns) == names
    assert rows_of(df) == expected


@pytest.mark.parametrize("name", sorted(k for k, (_, text) in ENTRIES.items() if not text))
def test_query_runs(spark, name):
    df = ENTRIES[name][0](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0
