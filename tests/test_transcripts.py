"""Transcripts, speakers, scores, audio and streams."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import audio
from tidemark.operators import scoring, transcript, vectors
from tidemark.streaming import jobs, tables


def test_accuracy_words(spark):
    e, a = transcript.normalized_words(F.lit("The quick brown fox's den")), transcript.normalized_words(F.lit("quick foxs; quick cat"))
    s = spark.range(1).select(transcript.accuracy(e, a).alias("s"), transcript.repetition(a).alias("r")).first()
    assert (s["s"]["recall"], round(s["s"]["precision"], 6), s["s"]["missing"]) == (0.5, round(2 / 3, 6), ["brown", "den"])
    assert s["r"] == 0.25


def test_runs_with_missing_speakers(spark):
    rows = [(1, 1, "spk_0", "a"), (1, 2, "spk_0", "b"), (1, 3, None, "c"), (1, 4, "spk_1", "d")]
    runs = transcript.speaker_runs(spark.createDataFrame(rows, "s int, t int, who string, x string"), ["s"], ["t"], "who", "x")
    assert [(r["speaker"], r["text"]) for r in runs.orderBy("run").collect()] == [("spk_0", "a b"), (None, "c"), ("spk_1", "d")]
    assert transcript.rendered(runs, ["s"]).first()["text"] == "Speaker 1: a b c\nSpeaker 2: d"


def test_dominant_first_seen_wins_ties(spark):
    rows = [(1, 1, "b"), (1, 2, "a"), (1, 3, "a"), (1, 4, "b"), (1, 5, None)]
    d = transcript.dominant(spark.createDataFrame(rows, "s int, t int, who string"), ["s"], "who", "t").first()
    assert (d["dominant"], d["times"]) == ("b", 2)


def test_chunks_keep_all_words():
    text = "One two. Three four!\n\nFive six seven eight nine ten. " + "x" * 50
    for limit in (8, 20, 30, 1000):
        parts = transcript.split_text(text, limit)
        assert all(0 < len(p) <= limit for p in parts)
        assert "".join("".join(parts).split()) == "".join(text.split())
    assert transcript.split_text("One two. Three four!", 12)[0] == "One two."


def best_by_brute_force(overlap):
    hyps, refs = sorted({h for h, _ in overlap}), sorted({r for _, r in overlap})
    refs += [None] * len(hyps)
    return max(sum(overlap.get((h, r), 0) for h, r in zip(hyps, p, strict=True)) for p in itertools.permutations(refs, len(hyps)))


def test_best_mapping_is_optimal():
    rng = np.random.default_rng(4)
    for _ in range(30):
        h, r = rng.integers(1, 5, 2)
        overlap = {(f"h{i}", f"r{j}"): float(rng.integers(0, 9)) for i in range(h) for j in range(r)}
        got = scoring.best_mapping(overlap)
        assert len(set(got.values())) == len(got)
        assert sum(overlap[x] for x in got.items()) == best_by_brute_force(overlap)


def test_diarization_error(spark):
    schema = "file string, start double, end double, label string"
    ref = spark.createDataFrame([("f", 0.0, 10.0, "a"), ("f", 10.0, 20.0, "b")], schema)
    hyp = spark.createDataFrame([("f", 0.0, 12.0, "x"), ("f", 12.0, 19.0, "y"), ("f", 20.0, 22.0, "y")], schema)
    r = scoring.diarization_error(ref, hyp, ["file"]).first()
    assert (r["missed"], r["false_alarm"], r["confusion"], r["total"]) == (1.0, 2.0, 2.0, 20.0)
    assert r["der"] == pytest.approx(0.25)


def test_gate_verdicts(spark):
    rows = [(1.0, 1.2, "lower"), (1.0, 0.8, "lower"), (1.0, 1.05, "higher"), (None, 1.0, "lower"), (1.0, None, "lower")]
    df = spark.createDataFrame(rows, "b double, c double, d string")
    v = df.select(scoring.gate_verdict(F.col("b"), F.col("c"), F.col("d"), F.lit(0.1), F.lit(0.01)).alias("v"))
    assert [r["v"] for r in v.collect()] == ["worse", "better", "pass", "new", "missing"]


def test_equal_error_near_scan(spark):
    rng = np.random.default_rng(3)
    same, diff = rng.normal(0.5, 0.2, 400).clip(-1, 1), rng.normal(0.0, 0.2, 400).clip(-1, 1)
    df = spark.createDataFrame([(True, float(x)) for x in same] + [(False, float(x)) for x in diff], "same boolean, score double")
    best = min((abs((same < t).mean() - (diff >= t).mean()), ((same < t).mean() + (diff >= t).mean()) / 2) for t in np.linspace(-1, 1, 2001))[1]
    assert vectors.equal_error(df).first()["equal_error"] == pytest.approx(best, abs=0.01)


def test_audio_levels(spark):
    pcm = F.array(*(F.lit(x) for x in (32767, 32767, 0, -32768, 100)))
    r = spark.range(1).select(
        audio.dbfs(F.lit(0.0)).alias("floor"), audio.dbfs(F.lit(1.0)).alias("full"), audio.rms_dbfs(F.array().cast("array<int>")).alias("none"), audio.clipped_fraction(pcm).alias("c"),
        audio.clipped_runs(pcm).alias("runs"), audio.gained(pcm, 6.0).alias("g"), audio.silent(F.array().cast("array<double>"), 0.1, 0.1).alias("s"),
    ).first()
    assert (r["floor"], r["full"], r["none"], r["c"], r["runs"], r["s"]) == (-120.0, 0.0, float("-inf"), 0.6, 0.4, True)
    assert r["g"] == [32767, 32767, 0, -32768, 200]


def memory_stream(spark, tmp_path, rows, schema):
    """Files read one by one, a micro-batch each."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{k}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def drained(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_stream_increments_and_alerts(spark, tmp_path):
    import datetime as dt

    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema = "series string, ts timestamp, process string, value double"
    rows = [[("a", t(1), "p", 5.0), ("a", t(2), "p", 8.0), ("a", t(3), "q", 2.0)]]
    drained(jobs.increments(memory_stream(spark, tmp_path, rows, schema), "1 minute"), "inc", tmp_path)
    assert sorted(r["increment"] for r in spark.table("inc").collect()) == [0.0, 2.0, 3.0]


def test_stream_window_counts(spark, tmp_path):
    import datetime as dt

    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [[("a", t(k)) for k in range(5)] + [("b", t(1))], [("c", t(500))]]
    s = memory_stream(spark, tmp_path, rows, "who string, ts timestamp")
    drained(jobs.windowed_alerts(s, ["who"], "ts", "1 minute", "10 seconds", 3), "alerts", tmp_path)
    assert [(r["who"], r["n"]) for r in spark.table("alerts").collect()] == [("a", 5)]


def test_stream_latency_join(spark, tmp_path):
    import datetime as dt

    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    a = memory_stream(spark, tmp_path / "a", [[("x", t(1)), ("y", t(2))]], "k string, sent timestamp")
    b = memory_stream(spark, tmp_path / "b", [[("x", t(3)), ("y", t(300))]], "k string, received timestamp")
    drained(jobs.latency_join(a, b, "k", "1 minute", "60 SECONDS"), "latency", tmp_path)
    assert [(r["k"], r["latency_ms"]) for r in spark.table("latency").collect()] == [("x", 2000.0)]


def test_stream_upsert_keeps_the_newest(spark, tmp_path):
    s = memory_stream(spark, tmp_path, [[("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z")]], "k string, v int, w string")
    q = tables.upserted(s, str(tmp_path / "out"), ["k"], "v", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["k"]: r["w"] for r in tables.current(spark, str(tmp_path / "out")).collect()}
    assert got == {"a": "z", "b": "y"}


def test_stream_late_labels_fill_and_never_overwrite(spark, tmp_path):
    import datetime as dt

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t = dt.datetime(2024, 1, 1)
    rows = [[("q", 0, None, t), ("q", 1, None, t)], [("q", 0, "a", t)], [("q", 0, "b", t)]]
    s = memory_stream(spark, tmp_path, rows, "sequence string, index int, speaker string, ts timestamp")
    drained(jobs.late_labels(s, 600_000), "late", tmp_path, "update")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [(r["index"], r["speaker"]) for r in spark.table("late").collect()]
    assert (0, "a") in got and (0, "b") not in got and (1, None) in got
