"""The queries of this subpackage with a DuckDB oracle, on the small tables."""

import duckdb
import pytest
from parity import compare

from pricefold.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    ok, msg = compare(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], con)
    assert ok, msg
