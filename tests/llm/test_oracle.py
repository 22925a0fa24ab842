"""Queries with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from tidemark.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = QUERIES[name](spark, DIR)
    q = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda row: [(v is not None, v) for v in row]  # noqa: E731 - nulls first
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=key) == sorted((tuple(r) for r in q.fetchall()), key=key)


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
