"""Queries against their SQL over whole tables."""

import duckdb
import pytest

from marlstone.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(map(tuple, df.select(*rel.columns).collect())) == sorted(rel.fetchall())
