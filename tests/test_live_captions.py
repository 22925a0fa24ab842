"""Live captions give what the batch folds give, whatever the order in which rows come, and keep little."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest

from tidemark.operators import captions
from tidemark.streaming import captions as live

T0, EPOCH = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, tzinfo=dt.UTC).timestamp()
EVENTS = "session string, seq long, ts timestamp, now double, turns array<struct<start:double,end:double,speaker:string,sure:double>>, begin double, end double, words array<struct<start:double,end:double>>, name string"
DRAFTS = "session string, seq long, ts timestamp, words array<struct<text:string,start:double,end:double>>, full_until double"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def at(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=seconds - EPOCH)


def session(rng: random.Random, name: str, base: float) -> list[tuple]:
    """Passes every 5 s over 10 s, sequences in between, ticks now and then; clocks in whole eighths of a second."""
    rows, seq = [], 0
    for k in range(1, 14):
        now = base + 5.0 * k
        turns = [(max(0.0, 5.0 * k - 10 + a), 5.0 * k - 10 + a + rng.randrange(1, 5), rng.choice("ab"), rng.choice([0.3, 0.5, 0.9])) for a in range(0, 10, 3)]
        rows.append((name, seq, at(now), now, turns, max(0.0, 5.0 * k - 10), 5.0 * k, None, None))
        for j in range(rng.randrange(3)):
            seq += 1
            when = now + rng.randrange(1, 30) / 8
            start = 5.0 * k - 4 + rng.randrange(8)
            rows.append((name, seq, at(when), when, None, None, None, [(start, start + 1), (start + 1, start + rng.choice([2, 40]))], f"{name}{k}-{j}"))
        seq += 1
        if rng.random() < 0.3:
            rows.append((name, seq, at(now + 4.875), now + 4.875, None, None, None, None, None))
            seq += 1
    return rows


def streamed(spark, tmp_path, rows, schema, name, run):
    """Rows in micro-batches of a file each, in the given order; a last row of another session moves the watermark on."""
    size = 7
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{k:05d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = run(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(600)
    assert q.exception() is None
    states = [s for p in q.recentProgress for s in p["stateOperators"]]
    return spark.table(name).collect(), states


def key(r):
    return str(sorted((r.asDict() if hasattr(r, "asDict") else r).items(), key=lambda x: x[0]))


def test_labels_of_a_shuffled_stream_are_those_of_the_batch(rocks, tmp_path):
    rng = random.Random(4)
    rows = session(rng, "x", EPOCH) + session(rng, "y", EPOCH + 3)
    rows.sort(key=lambda r: r[3] + rng.random() * 12)  # out of order by up to 12 s
    end = max(r[3] for r in rows)
    rows += [("z", k, at(end + 1000 + 100 * k), end + 1000 + 100 * k, None, None, None, None, None) for k in range(8)]
    batch = captions.labelled_sequences(rocks.createDataFrame(rows, EVENTS).drop("ts"), finished=True, timeout=9.0, history=20.0).collect()
    got, states = streamed(rocks, tmp_path, rows, EVENTS, "live_labels", lambda s: live.live_labels(s, "ts", "15 seconds", timeout=9.0, history=20.0))
    assert sorted(map(key, got)) == sorted(map(key, batch)) and len(got) > 20
    assert any(r["settled"] and None in r["speakers"] for r in got)


def test_captions_of_a_shuffled_stream_are_those_of_the_batch(rocks, tmp_path):
    rng = random.Random(5)
    rows = []
    for name in "xy":
        said = [f" w{k}" + rng.choice(["", "", ".", "..."]) for k in range(60)]
        for seq in range(40):
            k = max(0, seq - 6)
            words = [(said[j] if rng.random() < 0.85 else " hm", float(j), j + 0.5) for j in range(k, min(60, seq + rng.randrange(3)))]
            rows.append((name, seq, at(EPOCH + 2 * seq), words, float(k - 3) if seq % 11 == 10 else None))
    rows.sort(key=lambda r: (r[2] - T0).total_seconds() + rng.random() * 8)
    rows += [("z", k, at(EPOCH + 500 + 50 * k), [], None) for k in range(8)]
    batch = captions.caption_steps(rocks.createDataFrame(rows, DRAFTS).drop("ts")).collect()
    got, _ = streamed(rocks, tmp_path, rows, DRAFTS, "live_captions", lambda s: live.live_captions(s, "ts", "10 seconds"))
    ours = lambda rs: sorted(key(r) for r in rs if r["session"] != "z")
    assert ours(got) == ours(batch) and any(r["final"] for r in got) and any(r["forced"] for r in got)


class Cells:
    """List, map and value state in memory."""

    def __init__(self):
        self.v = {}

    def exists(self):
        return bool(self.v)

    def get(self):
        return self.v["x"]

    def put(self, x):
        self.v["x"] = list(x)

    def update(self, x):
        self.v["x"] = x

    def updateValue(self, k, v):  # noqa: N802
        self.v[k] = v

    def removeKey(self, k):  # noqa: N802
        del self.v[k]

    def iterator(self):
        return iter(list(self.v.items()))

    def clear(self):
        self.v.clear()


class Handle:
    def __init__(self):
        self.cells, self.timers = {}, set()

    def _cell(self, name, *_):
        return self.cells.setdefault(name, Cells())

    getMapState = getListState = getValueState = _cell  # noqa: N815

    def registerTimer(self, t):  # noqa: N802
        self.timers.add(t)


class Timer:
    def __init__(self, t):
        self.t = t

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.t


def test_a_long_session_keeps_little_and_a_silent_one_nothing():
    import pandas as pd

    h, p = Handle(), live.LiveTimeline("session", {"history": 20.0, "timeout": 8.0}, forget=100.0)
    p.init(h)
    most = 0
    for k in range(2000):
        now = 5.0 * k
        rows = [{"now": now, "turns": [{"start": now - 3.0, "end": now - 1.0, "speaker": "ab"[k % 2], "sure": 0.5}], "begin": now - 10, "end": now}, {"now": now, "words": [{"start": now - 2, "end": now + 60}], "name": f"s{k}"}]
        frame = pd.DataFrame([(int(now * 1000), 2 * k + j, json.dumps(r)) for j, r in enumerate(rows)], columns=["at", "seq", "row"])
        list(p.handleInputRows(("x",), iter([frame]), None))
        for t in sorted(t for t in h.timers if t <= now * 1000):
            h.timers.discard(t)
            list(p.handleExpiredTimer(("x",), None, Timer(t)))
        most = max(most, len(h.cells["held"].v) + len(h.cells["waiting"].v) + len(h.cells["spans"].v.get("x", [])))
    assert most < 20
    while h.timers:
        t = min(h.timers)
        h.timers.discard(t)
        list(p.handleExpiredTimer(("x",), None, Timer(t)))
    assert not any(c.v for c in h.cells.values())
