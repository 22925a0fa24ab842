"""Speech ranges: hysteresis over frame scores, counted speech, gaps that no pass covered."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranges_of(scores: list[float], on: float, off: float, least_speech: int, least_pause: int) -> list[tuple[int, int]]:
    """Frame ranges of speech: begins at ``on``, ends after ``least_pause`` frames under ``off``; short ones go."""
    out, start, quiet = [], None, 0
    for k, s in enumerate(scores):
        if start is None:
            if s >= on:
                start, quiet = k, 0
        elif s < off:
            quiet += 1
            if quiet >= least_pause:
                out.append((start, k + 1 - quiet))
                start = None
        else:
            quiet = 0
    if start is not None:
        out.append((start, len(scores) - quiet))
    return [(a, b) for a, b in out if b - a >= least_speech]


def speech_ranges(frames: DataFrame, key: str, order: str, score: str, on: float = 0.5, off: float = 0.35, least_speech: int = 3, least_pause: int = 3) -> DataFrame:
    """(key, start, end) of each series of frame scores: one ordered fold per series."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order)
        rows = [(f[key].iloc[0], a, b) for a, b in ranges_of(f[score].tolist(), on, off, least_speech, least_pause)]
        return pd.DataFrame(rows, columns=[key, "start", "end"])

    return frames.select(key, order, score).groupBy(key).applyInPandas(run, f"{key} {frames.schema[key].dataType.simpleString()}, start int, end int")


def counted_speech(ranges: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Seconds of speech that re-detected ranges add: each counts only beyond what was seen before."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("end").over(w), F.lit(0.0))
    return ranges.withColumn("added", F.greatest(F.lit(0.0), F.col("end") - F.greatest("start", seen)))


def uncovered(ranges: DataFrame, passes: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds of speech that no pass covered, per key."""
    from tidemark.operators.intervals import free_slots

    windows = ranges.select(*keys, F.monotonically_increasing_id().alias("uid"), "start", "end")
    return free_slots(windows, passes, keys, 1e-9).groupBy(*keys).agg(F.sum(F.col("slot_end") - F.col("slot_start")).alias("seconds"))


def shifted_by_drops(words: DataFrame, drops: DataFrame, keys: list[str]) -> DataFrame:
    """Times on the diarisation clock: less all audio dropped before. Words (keys, at), drops (keys, at, seconds)."""
    rows = words.select(*keys, "at", F.lit(0.0).alias("seconds"), F.lit(1).alias("_word")).unionByName(drops.select(*keys, "at", "seconds", F.lit(0).alias("_word")))
    w = Window.partitionBy(*keys).orderBy("at", "_word").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("shifted", F.col("at") - F.sum("seconds").over(w)).where("_word = 1").select(*keys, "at", "shifted")


def admitted(live: Column, ceiling: Column) -> Column:
    """The first session and unknown capacity are admitted; else one more must fit."""
    return F.when((live == 0) | ceiling.isNull(), True).otherwise(live + 1 <= ceiling)
