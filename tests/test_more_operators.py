"""Configuration, speech ranges, capacity, files and codes."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import audio, text
from tidemark.operators import config, jobs, speech, transcript, values, vectors


def test_config_findings_follow_the_environment(spark):
    schema = "declared_env string, is_development boolean, admin_api_key string, admin_session_secret string, db_password string, test_audio_service_key string, public_host string, public_url string"
    strong = "k" * 40
    rows = [("development", True, strong, strong, strong, strong, "10.0.0.1", "http://x"), ("production", True, "CHANGE_ME", strong, strong, strong, "172.32.0.1", "https://x"), ("prod", False, strong, "short-but-own", strong, strong, "192.168.1.9", "http://x")]
    got = sorted((r["env"], r["id"], r["severity"]) for r in config.findings(spark.createDataFrame(rows, schema)).collect())
    assert got == [
        ("production", "admin-api-key-placeholder", "critical"), ("production", "deployment-env-invalid", "warning"), ("production", "dev-flag-in-deployed-env", "critical"),
        ("production", "plain-http", "critical"), ("production", "secret-too-short", "critical"), ("production", "unroutable-host", "critical"),
    ]


@pytest.mark.parametrize(("host", "want"), [("10.1.2.3", True), ("172.15.0.1", False), ("172.31.9.9", True), ("8.8.8.8", False), ("300.1.1.1", False), ("host", False), ("224.0.0.1", True)])
def test_unroutable(spark, host, want):
    assert spark.range(1).select(config.unroutable(F.lit(host)).alias("u")).first()["u"] is want


def test_speech_hysteresis(spark):
    assert speech.ranges_of([0, 0.6, 0.4, 0.4, 0.2, 0.5, 0.2, 0.2, 0.2, 0.9, 0.1, 0.1, 0.1], 0.5, 0.35, 3, 3) == [(1, 6)]
    rows = [("a", k, s) for k, s in enumerate([0.9, 0.9, 0.9, 0.9])]
    df = spark.createDataFrame(rows, "key string, n int, score double")
    assert [(r["start"], r["end"]) for r in speech.speech_ranges(df, "key", "n", "score").collect()] == [(0, 4)]


def test_counted_and_uncovered_speech(spark):
    r = spark.createDataFrame([("s", 1, 0.0, 4.0), ("s", 2, 3.0, 6.0), ("s", 3, 1.0, 5.0), ("s", 4, 8.0, 9.0)], "k string, n int, start double, end double")
    assert [x["added"] for x in speech.counted_speech(r, ["k"], "n").orderBy("n").collect()] == [4.0, 2.0, 0.0, 1.0]
    p = spark.createDataFrame([("s", 0.0, 2.0)], "k string, start double, end double")
    ranges = spark.createDataFrame([("s", 1.0, 4.0), ("s", 8.0, 9.0)], "k string, start double, end double")
    assert speech.uncovered(ranges, p, ["k"]).first()["seconds"] == 3.0
    w = spark.createDataFrame([("s", 5.0), ("s", 12.0)], "k string, at double")
    d = spark.createDataFrame([("s", 4.0, 1.5), ("s", 10.0, 2.0)], "k string, at double, seconds double")
    assert [x["shifted"] for x in speech.shifted_by_drops(w, d, ["k"]).orderBy("at").collect()] == [3.5, 8.5]


def test_admission(spark):
    a = spark.range(1).select(speech.admitted(F.lit(0), F.lit(0)).alias("a"), speech.admitted(F.lit(3), F.lit(3)).alias("b"), speech.admitted(F.lit(9), F.lit(None).cast("int")).alias("c")).first()
    assert (a["a"], a["b"], a["c"]) == (True, False, True)


def test_noise_floor_is_interpolated(spark):
    loud, quiet = [0.5] * 160, [0.005] * 160
    df = spark.createDataFrame([(quiet + loud * 4,), ([0.1] * 10,)], "s array<double>")
    r = df.select(audio.noise_floor(F.col("s")).alias("f"), audio.snr(F.col("s")).alias("r")).collect()
    assert r[0]["f"] == pytest.approx(-46.0206 + 0.4 * 40, abs=1e-3) and r[0]["r"] > 20
    assert r[1]["f"] is None


def test_files_captions_and_codes(spark):
    df = spark.createDataFrame([(1, " a b  c d e ", dt.datetime(2024, 1, 2, 3, 4, 5))], "id int, t string, at timestamp")
    caps = text.timed_captions(df, "id", "t", 2, 0.5).orderBy("place").collect()
    assert [(c["start"], c["caption"]) for c in caps] == [(0.0, "a b"), (1.0, "c d"), (2.0, "e")]
    r = df.select(text.file_stamp(F.col("at")).alias("s"), text.transcript_file(F.lit("T"), F.col("at"), F.lit("x")).alias("f")).first()
    assert (r["s"], r["f"]) == ("2024-01-02_03-04-05", "T\n2024-01-02 03:04\n\nx\n")
    s = spark.createDataFrame([("u", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 12))], "uid string, start timestamp, end timestamp")
    codes = text.join_codes(s).orderBy("valid_start").collect()
    assert len(codes) == 3 and codes[-1]["valid_end"] == dt.datetime(2024, 1, 1, 0, 12)
    assert all(len(c["join_code"]) == 8 and c["join_code"].isalnum() for c in codes) and len({c["join_code"] for c in codes}) == 3


def test_more_labels_than_one_array_holds(spark):
    rng = __import__("random").Random(4)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    centers = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(23)], "label long, centroid array<double>")
    one, many = (sorted(map(tuple, vectors.nearest_label(df, centers, "vec_id", "embedding", "label", m).collect())) for m in (4096, 5))
    assert one == many and len(one) == 60


def test_what_a_worker_does_next(spark):
    rows = [("a", 1, "READY", 5.0, 9.0), ("a", 2, "READY", 1.0, 13.0), ("a", 3, "SLEEPING", 9.0, 1.0), ("b", 4, "SLEEPING", 10.0, 1.0), ("b", 5, "RUNNING", 0.0, 1.0), ("c", 6, "RUNNING", 0.0, 1.0), ("d", None, None, None, None)]
    df = spark.createDataFrame(rows, "worker string, job int, state string, period_start double, period double")
    at = lambda now: {r["worker"]: (r["job"], r["deadline"], r["idle"]) for r in jobs.next_jobs(df, F.lit(now)).collect()}
    assert at(9.0) == {"a": (1, 14.0, None), "b": (None, None, 1.0), "c": (None, None, None), "d": (None, None, None)}
    assert at(10.5) == {"a": (3, 10.0, None), "b": (4, 11.0, None), "c": (None, None, None), "d": (None, None, None)}


def test_halves_are_cut_where_a_chunk_ends(spark):
    texts = ["One. Two three four five six", "a", " ab ", "x" * 9, "para one\n\npara two. And more text here", 'He said "no." Then "yes!" went', "no end here at all", "\n\n", "a b"]
    got = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for t in texts], "t string").withColumn("h", values.bisected(F.col("t"))).collect()}
    for t in texts:
        bare = t.strip()
        cut = transcript.cut_point(bare, -(-len(bare) // 2)) if len(bare) >= 2 else 0
        want = [bare[:cut].strip(), bare[cut:].strip()]
        assert got[t] == (want if all(want) else None)
