"""Queries against their SQL on rows that the smallest tables lack."""

from __future__ import annotations

import datetime as dt

import duckdb

from pyspark.sql import functions as F

from tidemark.operators import config
from tidemark.plans.registry import ORACLE_SQL, QUERIES


def both(spark, where, name, table):
    """Sorted rows of a query and of its SQL on the table in ``where``."""
    df = QUERIES[name](spark, str(where))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{where}/{table}.parquet/*.parquet'")
    got, want = df.collect(), duck.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    return sorted(map(tuple, got), key=str), sorted(want, key=str)


def events_at_borders(spark, where):
    """Events just before, at and after half a second from a border of half days, some without a type or a value."""
    rows, border = [], dt.datetime(2024, 1, 5)
    for day in range(12):
        for k, ms in enumerate((-700, -501, -500, -499, -1, 0, 1, 499, 500, 501)):
            at = border + dt.timedelta(hours=12 * day, milliseconds=ms)
            rows.append((len(rows), at, k % 3, ("click", "view", None, "error")[(k + day) % 4], float(k) if k % 4 else None, "{}"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{where}/events.parquet")


def test_label_drift_rounds_to_the_nearest_second(spark, tmp_path):
    events_at_borders(spark, tmp_path)
    got, want = both(spark, tmp_path, "label_drift", "events")
    assert got == want and len(got) > 5


def test_latency_bins_round_to_the_nearest_second(spark, tmp_path):
    events_at_borders(spark, tmp_path)
    got, want = both(spark, tmp_path, "latency_bins", "events")
    assert got == want and len(got) > 30


def test_unroutable_hosts_for_every_first_part(spark, tmp_path):
    spark.range(600).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    got, want = both(spark, tmp_path, "unroutable_hosts", "supplier")
    assert got == want and len(got) == 600


def test_ranges_that_the_second_part_decides(spark):
    """The operator keeps the private, link-local and shared ranges that the query's addresses stay out of."""
    hosts = [(f"{a}.{b}.3.4",) for a in (100, 169, 172, 192) for b in range(256)]
    got = {r["host"] for r in spark.createDataFrame(hosts, "host string").where(config.unroutable(F.col("host"))).collect()}
    ranges = {100: range(64, 128), 169: [254], 172: range(16, 32), 192: [168]}
    assert got == {f"{a}.{b}.3.4" for a, inside in ranges.items() for b in inside}
