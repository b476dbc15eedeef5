"""Every registered query against its oracle SQL on the smallest tables."""

import os

import pytest

from tessera.queries import QUERIES, SQL
from tools.compare import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_oracle(spark, con, name):
    same, what = compare(spark, con, SF, name, QUERIES[name], SQL[name])
    assert same, what


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    df.collect()


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["change_id", "clause_id", "match_path", "n_paths"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
