"""Transcript and summary files, timed captions, join codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters of a join code, its length, and minutes between codes.
CODE_LETTERS, CODE_LENGTH, CODE_MINUTES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 8, 5


def file_stamp(ts: Column) -> Column:
    """A time as part of a file name."""
    return F.date_format(ts, "yyyy-MM-dd_HH-mm-ss")


def transcript_file(title: Column, at: Column, body: Column) -> Column:
    head = F.concat(title, F.lit("\n"), F.date_format(at, "yyyy-MM-dd HH:mm"), F.lit("\n\n"))
    return F.concat(head, F.coalesce(body, F.lit("")), F.lit("\n"))


def summary_file(title: Column, sections: Column) -> Column:
    """Title, then each (heading, text) that has a text."""
    kept = F.filter(sections, lambda s: F.coalesce(s["text"], F.lit("")) != "")
    return F.concat(title, F.array_join(F.transform(kept, lambda s: F.concat(F.lit("\n\n"), s["heading"], F.lit("\n"), s["text"])), ""), F.lit("\n"))


def timed_captions(df: DataFrame, key: str, text: str, words_each: int, seconds_a_word: float) -> DataFrame:
    """(key, place, start, caption): fragments of a text with the time at which each begins."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size("_w") / words_each).cast("int") - 1), lambda k: F.slice(F.col("_w"), k * words_each + 1, F.lit(words_each)))
    rows = df.select(key, words.alias("_w")).where(F.size("_w") > 0).select(key, F.posexplode(cut).alias("place", "c"))
    before = F.coalesce(F.sum(F.size("c")).over(Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select(key, "place", (before * seconds_a_word).alias("start"), F.array_join("c", " ").alias("caption"))


def join_codes(sessions: DataFrame, seed: int = 1) -> DataFrame:
    """A code for each period of a session (uid, start, end timestamps): the same for the same seed, session and period."""
    steps = F.sequence("start", F.col("end"), F.expr(f"INTERVAL {CODE_MINUTES} MINUTES"))
    rows = sessions.withColumn("valid_start", F.explode(steps)).where("valid_start < end")
    digits = [
        F.substr(F.lit(CODE_LETTERS), F.pmod(F.xxhash64(F.lit(seed + k), "uid", "valid_start"), F.lit(len(CODE_LETTERS))).cast("int") + 1, F.lit(1))
        for k in range(CODE_LENGTH)
    ]
    until = F.least(F.col("valid_start") + F.expr(f"INTERVAL {CODE_MINUTES} MINUTES"), F.col("end"))
    return rows.select("uid", F.concat(*digits).alias("join_code"), "valid_start", until.alias("valid_end"))


def next_visible(position: Column, known: Column) -> Column:
    """Rows a version poll returns: those newer than the version it knows."""
    return position > F.coalesce(known, F.lit(-1))
