"""Queries against their SQL twins, value by value."""

import duckdb
import pytest

from barlight.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_twin(spark, sf, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "conversations", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    twin = db.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in twin.description]
    want = twin.fetchall()
    frame = queries.QUERIES[name](spark, sf)
    assert sorted(frame.columns) == sorted(columns)
    got = [tuple(r) for r in frame.select(*columns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
