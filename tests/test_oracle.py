"""Every registered query against the same question in SQL, on the same files."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    yield connection
    connection.close()


def _sortable(row):
    return tuple((v is None, "" if v is None else repr(v)) for v in row)


def _same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and (a == b or (math.isnan(a) and math.isnan(b)))
    return a == b


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, sql, name):
    result = contract.queries()[name](spark, SF_DIR)
    question = contract.oracle_sql().get(name)
    if question is None:
        assert result.count() > 0
        return
    answer = sql.execute(question)
    expected_columns = [d[0] for d in answer.description]
    assert sorted(result.columns) == sorted(expected_columns)
    expected = sorted(answer.fetchall(), key=_sortable)
    found = sorted(map(tuple, result.select(*expected_columns).collect()), key=_sortable)
    assert len(found) == len(expected) > 0
    wrong = [(f, e) for f, e in zip(found, expected) if not all(map(_same, f, e))]
    assert not wrong, f"{len(wrong)} rows differ, first: {wrong[0]}"


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
