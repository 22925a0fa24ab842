"""The same logic on Structured Streaming: counters, alerts, latency, sessions and late labels."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_alerts(events: DataFrame, keys: list[str], ts: str, window: str, late: str, least: int) -> DataFrame:
    """Counts per key and tumbling window at or above ``least``; rows later than ``late`` are dropped."""
    w = F.window(ts, window).alias("w")
    return (
        events.withWatermark(ts, late).groupBy(*keys, w).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(*keys, F.col("w.start").alias("start"), "n")
    )


def latency_join(frames: DataFrame, transcripts: DataFrame, key: str, late: str, within: str) -> DataFrame:
    """Frames (key, sent) with the transcripts (key, received) that answer them within a time: an inner join whose state the watermarks bound."""
    a = frames.withWatermark("sent", late).alias("a")
    b = transcripts.withWatermark("received", late).alias("b")
    on = F.expr(f"a.{key} = b.{key} AND received >= sent AND received <= sent + INTERVAL {within}")
    ms = (F.col("received").cast("double") - F.col("sent").cast("double")) * 1000
    return a.join(b, on).select(F.col(f"a.{key}").alias(key), "sent", "received", ms.alias("latency_ms"))


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Paragraphs by silence: session windows per key."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(
        key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"
    )


#: How long a series or session that nobody hears of is remembered.
FORGET_MS = 24 * 3_600_000


def _ordered(frames: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    """All rows of a key in a batch, which may come in several frames, in order."""
    return pd.concat(list(frames)).sort_values(order)


def increments(polls: DataFrame, late: str) -> DataFrame:
    """Increments of cumulative counters (series, ts, process, value): one remembered reading a series, for FORGET_MS at most."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        out = []
        for f in [_ordered(frames, "ts")]:
            for ts, process, value in f[["ts", "process", "value"]].itertuples(index=False):
                if last is None:
                    inc = 0.0
                elif process != last[0] or value < last[1]:
                    inc = value
                else:
                    inc = value - last[1]
                last = (process, value)
                out.append((key[0], ts, float(inc)))
        if last is not None:
            state.update(last)
            state.setTimeoutDuration(FORGET_MS)
        yield pd.DataFrame(out, columns=["series", "ts", "increment"])

    return polls.withWatermark("ts", late).groupBy("series").applyInPandasWithState(
        step, "series string, ts timestamp, increment double", "process string, value double", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


class LateLabels(StatefulProcessor):
    """Words wait for a speaker; a label settles them, or a timeout leaves them without one. A label is never overwritten.

    Rows: sequence (the key), index, speaker (null for a word that arrives), ts.
    """

    def __init__(self, timeout_ms: int) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.words = handle.getMapState("words", "index int", "speaker string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        changed: dict[int, str | None] = {}
        for f in rows:
            for index, speaker in f[["index", "speaker"]].itertuples(index=False):
                known = self.words.getValue((int(index),))[0] if self.words.containsKey((int(index),)) else None
                speaker = None if pd.isna(speaker) else speaker
                if known is None:
                    self.words.updateValue((int(index),), (speaker,))
                    changed[int(index)] = speaker
        for old in list(self.handle.listTimers()):  # the timer runs from the last change
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        yield pd.DataFrame([(key[0], i, s, False) for i, s in sorted(changed.items())], columns=["sequence", "index", "speaker", "settled"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rows = [(key[0], k[0], v[0], True) for k, v in self.words.iterator()]
        self.words.clear()
        yield pd.DataFrame(rows, columns=["sequence", "index", "speaker", "settled"])

    def close(self) -> None:
        return


def late_labels(updates: DataFrame, timeout_ms: int) -> DataFrame:
    """Labels as they settle; needs a state store that holds several column families."""
    return updates.groupBy("sequence").transformWithStateInPandas(
        LateLabels(timeout_ms), "sequence string, index int, speaker string, settled boolean", "Update", "ProcessingTime"
    )
