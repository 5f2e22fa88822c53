"""Every registered query against its DuckDB oracle (tier 1, small scale)."""

import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == entry.entry(spark).columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    res = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert res["status"] in ("ok", "rows-only"), res
    if name not in ORACLES:
        assert res["rows"] > 0
