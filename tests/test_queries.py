"""Every registered query against its SQL over the given tables."""

import pytest
from compare import compare, connect, data_folder

import __spark_entry__ as entry_point

FOLDER = data_folder("0.001")
QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    (columns, ours, kinds), (sql_columns, theirs, sql_kinds) = compare(
        spark, con, FOLDER, QUERIES[name], SQL[name]
    )
    assert columns == sql_columns
    assert ours == theirs
    assert {c: k for c, k in kinds.items() if k} == {c: k for c, k in sql_kinds.items() if k}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).columns[0] == "lang"
