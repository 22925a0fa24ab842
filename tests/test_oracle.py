"""Every registered query with oracle SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from tidemark.plans.registry import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v) if isinstance(v, int | bool) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    q = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == cols
    want = sorted(tuple(cell(r[names.index(c)]) for c in cols) for r in q.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_run(spark, name):
    df = QUERIES[name](spark, DIR)
    assert len(df.columns) == len(set(df.columns))
    df.collect()
