"""Subscriptions, polls, probes, heartbeats, audio files, writes and materialisation on small fixtures."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import materialise
from tidemark.operators import tables as writes
from tidemark.sources import channels
from tidemark.sources.audio_frames import encode_wav
from tidemark.streaming import tables


def ts(s: str):
    return F.lit(s).cast("timestamp")


def test_subscription_puts_bad_lines_aside_and_fans_out(spark, tmp_path):
    (tmp_path / "in" / "fleet").mkdir(parents=True)
    (tmp_path / "in" / "fleet" / "a.txt").write_text('{"id": 1, "up": true}\n{"id": "x"}\nnot json\n{"id": 2, "up": false}\n')
    good, bad = channels.subscribed(spark, str(tmp_path / "in" / "*"), "id int, up boolean")
    q = channels.published(good.select("channel", "body.*"), {"up": F.col("up"), "down": ~F.col("up")}, str(tmp_path / "out"), str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["id"] for r in spark.read.json(str(tmp_path / "out" / "up")).collect()] == [1]
    assert [(r["channel"], r["id"]) for r in spark.read.json(str(tmp_path / "out" / "down")).collect()] == [("fleet", 2)]
    q = bad.writeStream.format("memory").queryName("quarantine").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["value"] for r in spark.table("quarantine").collect()) == ["not json", '{"id": "x"}']


def test_polls_have_one_reason_and_tell_restarts(spark):
    body = lambda p: json.dumps({"processUid": p})
    rows = [("2024-01-01 00:00:00", 200, body("a"), None), ("2024-01-01 00:00:10", 404, None, None), ("2024-01-01 00:00:20", 401, None, None), ("2024-01-01 00:00:30", 500, None, None),
            ("2024-01-01 00:00:40", 200, "{}", None), ("2024-01-01 00:00:50", None, None, "refused"), ("2024-01-01 00:01:00", 200, body("a"), None), ("2024-01-01 00:01:10", 200, body("b"), None)]
    raw = spark.createDataFrame([(t, "node", s, b, e) for t, s, b, e in rows], "t string, service string, status int, body string, error string").withColumn("poll_ts", F.col("t").cast("timestamp"))
    out = channels.polled(raw.drop("t"), "processUid string").orderBy("poll_ts").collect()
    assert [r["reason"] for r in out] == [None, "not-found", "unauthorized", "http-error", "malformed", "unreachable", None, None]
    assert [r["restarted"] for r in out] == [False] * 7 + [True]


def test_probes_since(spark):
    rows = [("2024-01-01 00:00:00", True), ("2024-01-01 00:00:10", False), ("2024-01-01 00:00:20", False)]
    raw = spark.createDataFrame([(t, "node", "ready", ok, 1.0) for t, ok in rows], "t string, service string, kind string, ok boolean, millis double").withColumn("probe_ts", F.col("t").cast("timestamp"))
    r = channels.probe_results(raw).first()
    assert (r["ok"], str(r["since"]), str(r["probe_ts"])) == (False, "2024-01-01 00:00:10", "2024-01-01 00:00:20")


def test_heartbeats_survive_a_new_checkpoint_and_snapshot(spark, tmp_path):
    schema = "id string, at timestamp, n int"
    for k, rows in enumerate([[("a", "2024-01-01 00:00:00", 1), ("b", "2024-01-01 00:00:00", 2)], [("a", "2024-01-01 00:00:30", 3)]]):
        spark.createDataFrame(rows, "id string, t string, n int").selectExpr("id", "cast(t as timestamp) at", "n").write.mode("append").json(str(tmp_path / f"in{k}"))
        s = spark.readStream.schema(schema).json(str(tmp_path / f"in{k}"))
        channels.heartbeats(s, str(tmp_path / "table"), ["id"], "at", "10 SECONDS", str(tmp_path / f"c{k}")).trigger(availableNow=True).start().awaitTermination(60)
    now = tables.current(spark, str(tmp_path / "table"))
    assert sorted((r["id"], r["n"]) for r in now.collect()) == [("a", 3), ("b", 2)]
    snap = channels.fleet_snapshot(now, now.limit(0), now, now, ts("2024-01-01 00:00:35")).first()
    assert [n["id"] for n in snap["nodes"]] == ["a"] and snap["sessions"] == []


def test_audio_is_mono_at_the_target_rate(spark):
    tone = (np.sin(np.arange(800) / 5) * 20000).astype(np.int16)
    wav = encode_wav(np.repeat(tone, 2), 8000, 2)
    out = channels.decoded_audio(spark.createDataFrame([(1, bytearray(wav)), (2, bytearray(b"no")), (3, None)], "k int, content binary"), "content").orderBy("k").collect()
    assert len(out[0]["samples"]) == 1600 and out[1]["samples"] is out[2]["samples"] is None
    assert np.allclose(out[0]["samples"][::2], tone / 32768, atol=1e-4)


def test_json_report(spark, tmp_path):
    channels.write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "r"))
    assert "".join(p.read_text() for p in (tmp_path / "r").glob("*.json")).strip() == '{"a":1,"b":null}'


def test_inserts_return_keys_and_members_keep_one_source(spark):
    rows = spark.createDataFrame([("x", 1), (None, 2)], "name string, n int")
    once, again = (sorted(r["uid"] for r in writes.inserted(rows, "uid", "device").collect()) for _ in range(2))
    assert once == again and len(set(once)) == 2 and all(len(u) == 36 for u in once)
    table = spark.createDataFrame([("k", "old", None)], "uid string, name string, seen string")
    assert sorted(r["name"] or "" for r in writes.appended(table, writes.inserted(rows, "uid", "d")).collect()) == ["", "old", "x"]
    audit = writes.audited(spark.createDataFrame([("me", 1, "b")], "actor string, p int, q string"), ["p", "q"]).first()
    assert json.loads(audit["params_summary"]) == {"p": 1, "q": "b"}
    m = spark.createDataFrame([("r", "d1", True), ("r", "d2", False), ("s", "d3", True)], "room string, device string, src boolean")
    add = lambda d, f: sorted((r["room"], r["device"], r["src"]) for r in writes.add_member(m, "room", "device", "src", F.lit("r"), F.lit(d), f).collect())
    assert add("d4", True) == [("r", "d1", False), ("r", "d2", False), ("r", "d4", True), ("s", "d3", True)]
    assert add("d4", False) == [("r", "d1", True), ("r", "d2", False), ("r", "d4", False), ("s", "d3", True)]
    assert len(add("d3", True)) == 3


@pytest.fixture
def rooms(spark):
    rows = [("r", "UTC", True, 1, None), ("q", "UTC", True, 1, "2024-01-07 23:00:00")]
    return spark.createDataFrame(rows, "uid string, timezone string, auto_session_enabled boolean, version int, t string").withColumn("last_materialized_at", F.col("t").cast("timestamp")).drop("t")


def test_stale_rooms_are_materialised(spark, rooms):
    day = lambda c: F.col(c).cast("timestamp")
    base = "uid string, room_uid string, anchor string, local_start_time string, local_end_time string, frequency string, days_of_week array<string>"
    full = lambda df: df.withColumn("anchor_start", day("anchor")).withColumn("active_start", day("anchor")).withColumn("active_end", F.lit(None).cast("timestamp")).drop("anchor")
    schedules = full(spark.createDataFrame([("s1", "r", "2024-01-01", "10:00", "11:00", "WEEKLY", ["MON", "WED"])], base))
    windows = full(spark.createDataFrame([("w1", "r", "2024-01-01", "09:00", "12:00", "WEEKLY", ["MON"])], base))
    old = [("a", "r", "s1", "SCHEDULED", "2024-01-08 10:00:00", "2024-01-08 11:00:00"), ("b", "r", None, "AUTO", "2024-01-09 09:00:00", "2024-01-09 10:00:00"), ("c", "r", None, "AUTO", "2024-01-08 11:00:00", "2024-01-08 12:00:00")]
    sessions = spark.createDataFrame(old, "uid string, room_uid string, schedule_uid string, type string, a string, b string")
    sessions = sessions.select("uid", "room_uid", "schedule_uid", "type", day("a").alias("effective_start"), day("b").alias("effective_end"), F.lit(None).cast("timestamp").alias("canceled_at"))
    got = materialise.materialised(rooms, schedules, windows, sessions, ts("2024-01-08 00:00:00"), ts("2024-01-07 12:00:00"))
    new = sorted((r["type"], str(r["effective_start"]), str(r["effective_end"])) for r in got.inserted.collect())
    assert new == [("AUTO", "2024-01-08 09:00:00", "2024-01-08 10:00:00"), ("SCHEDULED", "2024-01-10 10:00:00", "2024-01-10 11:00:00")]
    assert [r["uid"] for r in got.deleted.collect()] == ["b"]
    assert {r["uid"]: (r["version"], r["last_materialized_at"]) for r in got.rooms.collect()} == {"r": (2, dt.datetime(2024, 1, 8)), "q": (1, dt.datetime(2024, 1, 7, 23))}


def test_rooms_that_would_end_the_job_are_set_aside(spark):
    day = lambda c: F.col(c).cast("timestamp")
    rows = [("good", "Europe/Paris"), ("offset", "+02:00"), ("nowhere", "Mars/Olympus"), ("none", None), ("clock", "UTC"), ("days", "UTC"), ("window", "UTC"), ("fresh", "Mars/Olympus")]
    rooms = spark.createDataFrame([(u, z, True, 1, "2024-01-07 23:00:00" if u == "fresh" else None) for u, z in rows], "uid string, timezone string, auto_session_enabled boolean, version int, t string")
    rooms = rooms.withColumn("last_materialized_at", day("t")).drop("t")
    base = "uid string, room_uid string, anchor string, local_start_time string, local_end_time string, frequency string, days_of_week array<string>"
    full = lambda df: df.withColumn("anchor_start", day("anchor")).withColumn("active_start", day("anchor")).withColumn("active_end", F.lit(None).cast("timestamp")).drop("anchor")
    plan = [(f"s-{u}", u, "2024-01-01", "25:61" if u == "clock" else "10:00", "11:00", "WEEKLY", [] if u == "days" else ["MON"]) for u, _ in rows]
    schedules = full(spark.createDataFrame(plan, base))
    windows = full(spark.createDataFrame([("w", "window", "2024-01-01", "09:00", "12:00", "SOMETIMES", ["MON"]), ("v", "good", "2024-01-01", "09:00", "12:00", "WEEKLY", ["MON"])], base))
    none = "uid string, room_uid string, schedule_uid string, type string, effective_start timestamp, effective_end timestamp, canceled_at timestamp"
    got = materialise.materialised(rooms, schedules, windows, spark.createDataFrame([], none), ts("2024-01-08 00:00:00"), ts("2024-01-07 12:00:00"))
    assert {r["room_uid"]: r["reason"] for r in got.failed.collect()} == {
        "nowhere": "unknown time zone Mars/Olympus", "none": "unknown time zone (null)", "clock": "schedule s-clock: no time of day", "days": "schedule s-days: no days", "window": "window w: unknown frequency"
    }
    new = sorted((r["room_uid"], r["type"], str(r["effective_start"])) for r in got.inserted.collect())
    assert new == [("good", "AUTO", "2024-01-08 08:00:00"), ("good", "AUTO", "2024-01-08 10:00:00"), ("good", "SCHEDULED", "2024-01-08 09:00:00"), ("offset", "SCHEDULED", "2024-01-08 08:00:00")]
    assert sorted((r["uid"], r["version"]) for r in got.rooms.collect()) == sorted([("good", 2), ("offset", 2)] + [(u, 1) for u in ("nowhere", "none", "clock", "days", "window", "fresh")])
