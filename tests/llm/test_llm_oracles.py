"""Every training-data query with oracle SQL gives DuckDB's rows on the small tables."""

import duckdb
import pytest

from corpusindex.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(registry.oracle_sql()))
def test_oracle(spark, key):
    duck = duckdb.connect()
    for name in ("documents", "embeddings", "pages"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    found, expected = registry.queries()[key](spark, SF), duck.sql(registry.oracle_sql()[key])
    names = sorted(found.columns)
    assert sorted(expected.columns) == names
    at = [expected.columns.index(n) for n in names]
    ours = sorted((tuple(r[n] for n in names) for r in found.collect()), key=repr)
    assert ours == sorted((tuple(r[i] for i in at) for r in expected.fetchall()), key=repr)
