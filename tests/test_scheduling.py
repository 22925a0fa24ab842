"""Golden cases of schedules and intervals."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals, schedule

UTC = dt.UTC


def stamp(text):
    return F.lit(text).cast("timestamp")


def utc(spark, local, zone):
    row = spark.range(1).select(F.date_format(schedule.local_to_utc(stamp(local), F.lit(zone)), "yyyy-MM-dd HH:mm").alias("u")).first()
    return row["u"]


@pytest.mark.parametrize(
    ("local", "zone", "want"),
    [
        ("2024-03-10 02:30:00", "America/New_York", "2024-03-10 07:00"),
        ("2024-11-03 01:30:00", "America/New_York", "2024-11-03 06:30"),
        ("2024-07-01 09:00:00", "America/New_York", "2024-07-01 13:00"),
        ("2024-04-07 01:45:00", "Australia/Lord_Howe", "2024-04-06 15:15"),
        ("2024-05-05 05:05:00", "UTC", "2024-05-05 05:05"),
    ],
)
def test_local_to_utc(spark, local, zone, want):
    assert utc(spark, local, zone) == want


def test_local_to_utc_against_zoneinfo(spark):
    zone = ZoneInfo("Europe/Berlin")
    start = dt.datetime(2024, 3, 30)
    locals_ = [start + dt.timedelta(minutes=15 * k) for k in range(300)]
    rows = [(l.strftime("%Y-%m-%d %H:%M:%S"),) for l in locals_]
    df = spark.createDataFrame(rows, "l string")
    got = [r["u"] for r in df.select("l", F.date_format(schedule.local_to_utc(F.col("l").cast("timestamp"), F.lit("Europe/Berlin")), "yyyy-MM-dd HH:mm").alias("u")).orderBy("l").collect()]
    want = []
    for l in locals_:
        t = l.replace(tzinfo=zone).astimezone(UTC)
        if t.astimezone(zone).replace(tzinfo=None) != l:  # skipped: the transition
            t = dt.datetime(2024, 3, 31, 1, tzinfo=UTC)
        want.append(t.strftime("%Y-%m-%d %H:%M"))
    assert got == want


def schedules(spark, **over):
    row = {
        "uid": "s", "timezone": "America/New_York", "anchor_start": dt.datetime(2024, 1, 1), "active_start": dt.datetime(2024, 1, 1), "active_end": None,
        "local_start_time": "09:00", "local_end_time": "10:00", "frequency": "WEEKLY", "days_of_week": ["MON"],
    } | over
    schema = "uid string, timezone string, anchor_start timestamp, active_start timestamp, active_end timestamp, local_start_time string, local_end_time string, frequency string, days_of_week array<string>"
    return spark.createDataFrame([tuple(row[c.split()[0]] for c in schema.split(", "))], schema)


def run(spark, begin, end, **over):
    o = schedule.occurrences(schedules(spark, **over), stamp(begin), stamp(end)).orderBy("start_utc")
    return [(r["a"], r["b"]) for r in o.select(F.date_format("start_utc", "MM-dd HH:mm").alias("a"), F.date_format("end_utc", "MM-dd HH:mm").alias("b")).collect()]


def test_weekly_keeps_wall_time_over_the_jump(spark):
    got = run(spark, "2024-03-04 00:00:00", "2024-03-19 00:00:00")
    assert got == [("03-04 14:00", "03-04 15:00"), ("03-11 13:00", "03-11 14:00"), ("03-18 13:00", "03-18 14:00")]


def test_biweekly_follows_the_anchor_week(spark):
    got = run(spark, "2024-01-15 00:00:00", "2024-02-13 00:00:00", frequency="BIWEEKLY", anchor_start=dt.datetime(2024, 1, 1, 12))
    assert [a for a, _ in got] == ["01-15 14:00", "01-29 14:00", "02-12 14:00"]


def test_once_and_midnight_wrap(spark):
    got = run(spark, "2024-01-01 00:00:00", "2024-01-10 00:00:00", frequency="ONCE", days_of_week=None, anchor_start=dt.datetime(2024, 1, 2, 12), local_start_time="22:00", local_end_time="01:30")
    assert got == [("01-03 03:00", "01-03 06:30")]


def test_clipping_drops_short_residues(spark):
    end = dt.datetime(2024, 1, 8, 14, 0, 30)
    assert run(spark, "2024-01-08 00:00:00", "2024-01-09 00:00:00", active_end=end) == []
    end = dt.datetime(2024, 1, 8, 14, 30)
    assert run(spark, "2024-01-08 00:00:00", "2024-01-09 00:00:00", active_end=end) == [("01-08 14:00", "01-08 14:30")]


def test_overlap_rules_differ_on_boundaries(spark):
    a, b, c = (F.lit(float(x)) for x in (0, 10, 20))
    row = spark.range(1).select(
        intervals.overlaps(a, b, b, c).alias("half"), intervals.overlaps_closed(a, b, b, c).alias("closed"), intervals.overlaps(a, F.lit(None).cast("double"), c, None or c + 1).alias("open")
    ).first()
    assert (row["half"], row["closed"], row["open"]) == (False, True, True)


def test_free_slots_and_bucketed_join(spark):
    w = spark.createDataFrame([("r", 1, 0.0, 1000.0)], "room string, uid int, start double, end double")
    b = spark.createDataFrame([("r", 100.0, 200.0), ("r", 150.0, 300.0), ("r", 340.0, 900.0)], "room string, start double, end double")
    got = [(r["slot_start"], r["slot_end"]) for r in intervals.free_slots(w, b, ["room"]).orderBy("slot_start").collect()]
    assert got == [(0.0, 100.0), (900.0, 1000.0)]
    pairs = intervals.overlap_join(b, b, ["room"], 37.0, 1e6).where("l_start < r_start")
    assert [(r["l_start"], r["r_start"]) for r in pairs.collect()] == [(100.0, 150.0)]


def test_nearest_and_exclusive_runs(spark):
    words = spark.createDataFrame([("f", 1, 0.0, 1.0), ("f", 2, 5.0, 6.0)], "file string, uid int, start double, end double")
    segs = spark.createDataFrame([("f", 1.5, 3.0, "a"), ("f", 8.0, 9.0, "b")], "file string, start double, end double, label string")
    got = {r["l_uid"]: r["label"] for r in intervals.nearest(words, segs, ["file"], "label", 1.0, 10.0, 1e6).collect()}
    assert got == {1: "a"}
    turns = spark.createDataFrame([("f", 0.0, 10.0, "a"), ("f", 4.0, 5.0, "b"), ("f", 20.0, 23.0, "b")], "file string, start double, end double, label string")
    runs = sorted((r["label"], r["start"], r["end"]) for r in intervals.exclusive_runs(turns, ["file"], "label", 1.0, 2.0).collect())
    assert runs == [("a", 0.0, 10.0), ("b", 20.0, 23.0)]


def test_conflicts_and_reconcile(spark):
    o = spark.createDataFrame(
        [("r", "a", dt.datetime(2024, 1, 1, 9), dt.datetime(2024, 1, 1, 10)), ("r", "b", dt.datetime(2024, 1, 1, 9, 30), dt.datetime(2024, 1, 1, 11)), ("r", "c", dt.datetime(2024, 1, 1, 11), dt.datetime(2024, 1, 1, 12))],
        "room_uid string, uid string, start_utc timestamp, end_utc timestamp",
    )
    assert [(r["uid_a"], r["uid_b"]) for r in schedule.conflicts(o).collect()] == [("a", "b")]
    d = spark.createDataFrame([("r", 5, 9), ("r", 20, 30)], "room string, start long, end long")
    c = spark.createDataFrame([("r", 5, 9), ("r", 8, 15), ("r", 40, 50), ("r", 1, 2)], "room string, start long, end long")
    got = {(r["start"], r["action"]) for r in schedule.reconcile(d, c, ["room"], F.lit(10)).collect()}
    assert got == {(5, "keep"), (20, "insert"), (8, "preserve"), (40, "delete"), (1, "past")}
