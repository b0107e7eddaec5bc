"""Every query with oracle SQL gives DuckDB's rows on the small tables."""

import math
import os

import duckdb
import pytest

from corpusindex.jobs import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


@pytest.mark.parametrize("key", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, key):
    found = registry.queries()[key](spark, SF)
    names = sorted(found.columns)
    expected = duck.sql(registry.oracle_sql()[key])
    assert sorted(expected.columns) == names
    at = [expected.columns.index(n) for n in names]
    ours = sorted((tuple(plain(r[n]) for n in names) for r in found.collect()), key=repr)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in expected.fetchall()), key=repr)
    assert ours == theirs
