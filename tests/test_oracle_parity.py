"""Every query with an oracle must match DuckDB on the same parquet tables
(row count, columns and values after the query's reported rounding)."""

import pytest

import __spark_entry__ as entry
from parity import compare, duck
from pricefold.plans.registry import load_all

BASE = load_all()
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in BASE}
QUERIES = {name: run for name, run in entry.queries().items() if name in BASE}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_dir, con, name):
    ok, msg = compare(QUERIES[name](spark, sf_dir), ORACLES[name], con)
    assert ok, f"{name}: {msg}"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).toPandas()
    assert len(rows) and not rows.isna().all(axis=1).any()
    numbers = rows.select_dtypes('number')
    assert (numbers.abs().max().dropna() < 1e12).all()


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "opt_price" in df.columns
