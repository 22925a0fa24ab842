"""Counters, quantiles, alert edges, fleet and formats."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import alerts, fleet, metrics, paging
from tidemark.sources import audio_frames, text_formats


def test_counter_increments_reset_and_restart(spark):
    rows = [("a", 1, "p", 5.0), ("a", 2, "p", 9.0), ("a", 3, "p", 2.0), ("a", 4, "q", 7.0), ("b", 1, "p", 3.0)]
    df = spark.createDataFrame(rows, "series string, ts int, process string, value double")
    got = [r["increment"] for r in metrics.counter_increments(df, ["series"], ["ts"], "value", "process").orderBy("series", "ts").collect()]
    assert got == [0.0, 4.0, 2.0, 7.0, 0.0]


def test_nearest_rank_quantiles(spark):
    for n in (1, 2, 3, 19, 20, 21, 100):
        df = spark.createDataFrame([(0, float(k)) for k in range(1, n + 1)], "k int, v double")
        r = metrics.summary(df, ["k"], "v").first()
        assert [r[f"p{q}"] for q in (50, 95, 99)] == [float(max(1, math.ceil(q * n / 100))) for q in (50, 95, 99)]


def alert_ids(spark, values):
    now = dt.datetime(2024, 1, 1, 0, 10)
    rows = [(now - dt.timedelta(seconds=age), m, "s", float(v)) for m, v, age in values]
    df = spark.createDataFrame(rows, "ts timestamp, metric string, series string, value double")
    return [r["id"] for r in alerts.evaluate(df, F.lit(now)).collect()]


def test_alert_thresholds(spark):
    assert alert_ids(spark, [("upstream_retry", 3, 5), ("decode_drop", 9, 5)]) == ["upstream-churn"]
    assert alert_ids(spark, [("upstream_retry", 3, 121)]) == []
    assert alert_ids(spark, [("periods_run", 10, 1), ("periods_dropped", 10, 1)]) == ["transcription-saturation"]
    assert alert_ids(spark, [("periods_run", 15, 1), ("periods_dropped", 5, 1)]) == ["transcription-tail-overrun"]
    assert alert_ids(spark, [("rtf_p95", 2.0, 1)]) == ["transcription-saturation"]
    assert alert_ids(spark, [("jobs", 20, 1), ("rtf_sum", 9, 1)]) == ["transcription-falling-behind"]
    assert alert_ids(spark, [("jobs", 20, 1), ("rtf_sum", 9, 1), ("device_cpu", 1, 1)]) == []
    assert alert_ids(spark, [("auth_fail", 3, 1), ("auth_ok", 2, 1)]) == ["auth-failure"]
    assert alert_ids(spark, [("close_auth_fail", 5, 1)]) == ["auth-failure"]
    assert alert_ids(spark, [("status_up", 0, 1), ("status_unauthorized", 1, 1)]) == ["status-poll-refused"]
    assert alert_ids(spark, [("status_up", 0, 1), ("worker_alive", 0, 1)]) == ["worker-dead", "status-poll-unavailable"]
    assert alert_ids(spark, [("canary_recall", 0.4, 1), ("canary_latency_seconds", 15, 1)]) == ["canary-recall"]
    assert alert_ids(spark, [("diarization_audio_seconds", 60, 1), ("diarization_uncovered_seconds", 6, 1), ("diarization_lag_p95", 20, 1)]) == ["diarization-uncovered"]


def test_probe_down_needs_two_in_a_row(spark):
    rows = [("a", 1, True), ("a", 2, False), ("a", 3, False), ("b", 1, False), ("b", 2, True), ("b", 3, False)]
    df = spark.createDataFrame(rows, "target string, ts int, healthy boolean")
    assert [(r["target"], r["failures"]) for r in alerts.probe_down(df).collect()] == [("a", 2)]


def test_stage_depths_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x")], "parent string, child string")
    nodes = spark.createDataFrame([(s,) for s in "abcxy"], "stage string")
    got = {r["stage"]: r["depth"] for r in fleet.stage_depths(edges, nodes).collect()}
    assert got == {"a": 1, "b": 2, "c": 3, "x": None, "y": None}


def test_provider_capacity_is_unknown_if_one_is(spark):
    rows = [("p", "h1", 2, "degraded", 4), ("p", "h2", 3, "ok", None), ("q", "h1", 1, "down", 5)]
    df = spark.createDataFrame(rows, "provider string, host string, sessions int, status string, capacity int")
    got = {r["provider"]: (r["sessions"], r["status"], r["capacity"]) for r in fleet.merge_providers(df).collect()}
    assert got == {"p": (5, "ok", None), "q": (1, "down", 5)}


def test_parsed_splits_bad_rows(spark):
    df = spark.createDataFrame([('{"k": 1}',), ("{oops",), (None,)], "raw string")
    good, bad = fleet.parsed(df, "raw", "k long")
    assert [r["body"]["k"] for r in good.collect()] == [1]
    assert bad.count() == 2


def test_cursor_round_trip_and_garbage(spark):
    df = spark.createDataFrame([(1, "ä/+?"), (22, "")], "id int, name string").withColumn("c", paging.cursor("id", "name"))
    back = df.select("id", "name", paging.from_cursor(F.col("c"), "id int, name string").alias("r")).collect()
    assert all((r["id"], r["name"]) == (r["r"]["id"], r["r"]["name"]) for r in back)
    bad = spark.createDataFrame([("!!",), ("abc",), ("a",)], "c string").select(paging.from_cursor(F.col("c"), "id int").alias("r"))
    assert all(r["r"] is None or r["r"]["id"] is None for r in bad.collect())


def test_word_similarity_prefers_best_extent():
    assert paging._word_similarity("word", "two words") > paging._word_similarity("word", "sword fish")
    assert paging._word_similarity("room", "room") == 1.0


def test_frames_round_trip_and_damage(spark):
    good = audio_frames.encode_frame("c1", b"\x01\x02", sent_at=12.5, stage_depth=300)
    flipped = good[:-6] + bytes([good[-6] ^ 1]) + good[-5:]
    df = spark.createDataFrame([(good,), (flipped,), (b"x",), (None,)], "data binary")
    rows = [r["frame"] for r in audio_frames.decoded_frames(df, "data").collect()]
    assert (rows[0]["chunk_id"], rows[0]["sent_at"], rows[0]["stage_depth"], bytes(rows[0]["audio"])) == ("c1", 12.5, 300, b"\x01\x02")
    assert [r["error"] for r in rows[1:]] == ["checksum", "not a frame", "not a frame"]
    crc = df.limit(1).select(audio_frames.crc_of_frame(F.col("data")).alias("c")).first()["c"]
    assert crc.to_bytes(4, "little") == good[-4:]


def test_wav_chunks(spark):
    pcm = np.arange(-500, 500, dtype=np.int16)
    df = spark.createDataFrame([("f", audio_frames.encode_wav(pcm, 8000, 1))], "path string, content binary")
    rows = audio_frames.wav_chunks(df, 50).orderBy("chunk").collect()
    assert [len(r["pcm"]) for r in rows] == [400, 400, 200]
    assert [x for r in rows for x in r["pcm"]] == pcm.tolist()


def test_text_formats(spark, tmp_path):
    turns = spark.createDataFrame([("f", 1.0, 2.5, "a")], "file string, start double, end double, label string")
    text_formats.write_rttm(turns, str(tmp_path / "r"))
    assert [tuple(r) for r in text_formats.read_rttm(spark, str(tmp_path / "r")).collect()] == [("f", 1.0, 2.5, "a")]
    text_formats.write_uem(turns, str(tmp_path / "u"))
    assert [tuple(r) for r in text_formats.read_uem(spark, str(tmp_path / "u")).collect()] == [("f", 1.0, 2.5)]
    row = spark.range(1).select(
        text_formats.job_periods(F.lit("a=500, b=x,c=-1,=3,d=250")).alias("p"),
        text_formats.series_key(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))).alias("k"),
        text_formats.escaped(F.lit('a"\\\n')).alias("e"),
        text_formats.merged_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")), F.create_map(F.lit("b"), F.lit("2"))).alias("m"),
    ).first()
    assert (row["p"], row["k"], row["e"], row["m"]) == ({"a": 500.0, "d": 250.0}, "a=1,b=2", 'a\\"\\\\\\n', {"a": "1", "b": "2"})
