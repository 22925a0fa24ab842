"""Queries without SQL read every row of their tables."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from tidemark.operators import scoring
from tidemark.plans.registry import QUERIES

DIR = "/root/testdata/sf0.01"


def test_join_codes_of_every_order(spark):
    orders = {str(r[0]) for r in duckdb.sql(f"SELECT o_orderkey FROM '{DIR}/orders.parquet'").fetchall()}
    codes = QUERIES["join_codes"](spark, DIR).collect()
    assert {r["uid"] for r in codes} == orders
    assert len(codes) == 12 * len(orders)


def test_diarization_error_counts_every_turn(spark):
    turns = duckdb.sql(f"SELECT o_custkey % 20, epoch(o_orderdate) / 86400, o_custkey % 3, o_custkey % 4 FROM '{DIR}/orders.parquet'").fetchall()
    assert any(t[0] is not None for t in turns)
    ref, hyp = {}, {}  # half days of a file: labels that speak in them; all bounds are whole or half days
    for file, day, r, h in turns:
        for k in range(int(2 * day), int(2 * day) + 40):
            ref.setdefault((file, k), set()).add(r)
            hyp.setdefault((file, k + 4), set()).add(h)
    o = spark.read.parquet(f"{DIR}/orders.parquet")
    day = F.unix_timestamp("o_orderdate") / 86_400
    side = lambda shift, n: o.select((F.col("o_custkey") % 20).alias("file"), (day + shift).alias("start"), (day + shift + 20).alias("end"), (F.col("o_custkey") % n).cast("string").alias("label"))
    got = {r["file"]: r for r in scoring.diarization_error(side(0.0, 3), side(2.0, 4), ["file"], width=100.0).collect()}
    assert set(got) == {t[0] for t in turns}
    for file in got:
        cells = {k for k in {*ref, *hyp} if k[0] == file}
        miss = sum(max(0, len(ref.get(c, ())) - len(hyp.get(c, ()))) for c in cells) / 2
        alarm = sum(max(0, len(hyp.get(c, ())) - len(ref.get(c, ()))) for c in cells) / 2
        total = sum(len(ref.get(c, ())) for c in cells) / 2
        assert (got[file]["missed"], got[file]["false_alarm"], got[file]["total"]) == (miss, alarm, total)
