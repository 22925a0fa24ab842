"""Transcript analytics: words, recall, repetition, speaker runs, labels, rendering, chunking."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that carry no signal.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his in is it its of on or she that the they this to was were will with you"
).split()
#: Share of common trigrams from which a segment repeats the one before.
REPEAT = 0.7


def normalized_words(text: Column) -> Column:
    """Lower-cased words without apostrophes and stop words, in order."""
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "['’]", ""), "[^a-z0-9]+")
    return F.filter(parts, lambda w: (w != "") & ~w.isin(STOP_WORDS))


def word_count(text: Column) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def accuracy(expected: Column, actual: Column) -> Column:
    """struct(recall, precision, f1, missing) over distinct words; 0 where a side is empty."""
    e, a = F.array_distinct(expected), F.array_distinct(actual)
    both = F.size(F.array_intersect(e, a)).cast("double")
    recall = F.when(F.size(e) > 0, both / F.size(e)).otherwise(0.0)
    precision = F.when(F.size(a) > 0, both / F.size(a)).otherwise(0.0)
    f1 = F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)
    return F.struct(recall.alias("recall"), precision.alias("precision"), f1.alias("f1"), F.sort_array(F.array_except(e, a)).alias("missing"))


def repetition(words: Column) -> Column:
    """1 - distinct / all words; 0 without words."""
    return F.when(F.size(words) > 0, 1 - F.size(F.array_distinct(words)) / F.size(words)).otherwise(0.0)


def trigrams(words: Column) -> Column:
    """Distinct word trigrams; fewer than three words are one gram."""
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.array_join(F.slice(words, i, F.lit(3)), " "))
    return F.when(F.size(words) < 3, F.array(F.array_join(words, " "))).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def repeats_previous(df: DataFrame, series: list[str], order: list[str], text: str, limit: float = REPEAT) -> DataFrame:
    """``repeats``: whether a segment shares more than ``limit`` of its trigrams with the one before."""
    words = F.filter(F.split(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+"), lambda w: w != "")
    t = df.withColumn("_t", F.transform(trigrams(words), lambda g: F.xxhash64(g)))  # eight bytes a trigram go through the sort
    before = F.lag("_t").over(Window.partitionBy(*series).orderBy(*order))
    return t.withColumn("repeats", F.coalesce(jaccard(F.col("_t"), before) > limit, F.lit(False))).drop("_t")


def speaker_runs(df: DataFrame, series: list[str], order: list[str], speaker: str, text: str) -> DataFrame:
    """Consecutive rows of one speaker as (series, run, speaker, text, first, last); null is a speaker of its own."""
    w = Window.partitionBy(*series).orderBy(*order)
    new = (F.row_number().over(w) == 1) | ~F.col(speaker).eqNullSafe(F.lag(speaker).over(w))
    runs = df.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(w))
    parts = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    out = runs.groupBy(*series, "run").agg(
        F.first(speaker).alias("speaker"), F.transform(parts, lambda p: p["_t"]).alias("_p"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last")
    )
    return out.withColumn("text", F.array_join("_p", " ")).drop("_p")


def display_name(speaker: Column) -> Column:
    """spk_N as Speaker N+1; other names stay."""
    n = F.regexp_extract(speaker, r"^spk_(\d+)$", 1)
    return F.when(n != "", F.concat(F.lit("Speaker "), (n.cast("int") + 1).cast("string"))).otherwise(speaker)


def rendered(runs: DataFrame, series: list[str]) -> DataFrame:
    """One text a series: a line per run with a speaker; runs without one continue the line."""
    line = F.when(F.col("speaker").isNull(), F.concat(F.lit(" "), F.col("text"))).otherwise(
        F.concat(F.lit("\n"), display_name(F.col("speaker")), F.lit(": "), F.col("text"))
    )
    parts = F.sort_array(F.collect_list(F.struct("run", line.alias("line"))))
    return runs.groupBy(*series).agg(F.regexp_replace(F.array_join(F.transform(parts, lambda p: p["line"]), ""), r"^[\n ]", "").alias("text"))


def paragraphs(df: DataFrame, series: list[str], order: list[str], text: str) -> DataFrame:
    """Non-empty texts of a series joined by a blank line."""
    kept = df.where(F.trim(F.coalesce(text, F.lit(""))) != "")
    parts = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return kept.groupBy(*series).agg(F.array_join(F.transform(parts, lambda p: p["_t"]), "\n\n").alias("text"))


def dominant(df: DataFrame, keys: list[str], label: str, order: str) -> DataFrame:
    """Commonest label that is not null; of equals the one seen first."""
    n = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    return n.groupBy(*keys).agg(F.max_by(label, F.struct("n", -F.col("o"))).alias("dominant"), F.max("n").alias("times"))


def last_attributed(df: DataFrame, keys: list[str], label: str, order: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(*keys).agg(F.max_by(label, order).alias("last_speaker"))


def merged_labels(existing: Column, update: Column) -> Column:
    """Late labels fill holes and never overwrite."""
    return F.zip_with(existing, update, lambda a, b: F.coalesce(a, b))


def awaiting(labels: Column) -> Column:
    return F.coalesce(F.exists(labels, lambda x: x.isNull()), F.lit(True))


#: Marks that end a sentence, and what may close after them.
MARKS, CLOSERS = ".!?", "\"')]"


def cut_point(text: str, limit: int) -> int:
    """Where a chunk of at most ``limit`` letters ends: after the last paragraph, else sentence, else word, else hard."""
    head = text[:limit]
    at = head.rfind("\n\n")
    if at > 0:
        return at + 2
    best = 0
    for k in range(len(head) - 1):
        if head[k] in MARKS:
            e = k + 1
            while e < len(head) and head[e] in CLOSERS:
                e += 1
            if e < len(head) and head[e].isspace():
                best = e + 1
    if best:
        return best
    space = max((k for k in range(len(head)) if head[k].isspace()), default=-1)
    return space + 1 if space > 0 else limit


def split_text(text: str, limit: int) -> list[str]:
    """Chunks of at most ``limit`` letters, blank ones dropped, ends trimmed."""
    out = []
    while text:
        at = len(text) if len(text) <= limit else cut_point(text, limit)
        if part := text[:at].strip():
            out.append(part)
        text = text[at:]
    return out


def chunked(df: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """(key, index, chunk) of every text, in Arrow batches: each cut depends on the one before."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, c) for k, t in zip(f[key], f[text], strict=True) for i, c in enumerate(split_text(t or "", limit))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "chunk"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, chunk_index int, chunk string")
