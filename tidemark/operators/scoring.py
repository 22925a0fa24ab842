"""Scores of labelled timelines, regression gates and paired runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.intervals import merged, overlap_join, shared_seconds, stepped
from tidemark.operators.presence import cut


def best_mapping(overlap: dict[tuple[str, str], float]) -> dict[str, str]:
    """One-to-one map of hypothesis to reference labels that shares the most time: augmenting rows over potentials."""
    hyps, refs = sorted({h for h, _ in overlap}), sorted({r for _, r in overlap})
    n = max(len(hyps), len(refs))
    cost = [[-overlap.get((hyps[i], refs[j]), 0.0) if i < len(hyps) and j < len(refs) else 0.0 for j in range(n)] for i in range(n)]
    u, v, owner = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, seen, way = [float("inf")] * (n + 1), [False] * (n + 1), [0] * (n + 1)
        while True:
            seen[j0] = True
            i0, step, j1 = owner[j0], float("inf"), 0
            for j in range(1, n + 1):
                if not seen[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < step:
                        step, j1 = least[j], j
            for j in range(n + 1):
                if seen[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    pairs = {hyps[owner[j] - 1]: refs[j - 1] for j in range(1, n + 1) if owner[j] <= len(hyps) and j <= len(refs)}
    return {h: r for h, r in pairs.items() if overlap.get((h, r), 0) > 0}


def scored_regions(reference: DataFrame, hypothesis: DataFrame, keys: list[str], regions: DataFrame | None, collar: float, width: float) -> DataFrame:
    """(start, end) per file that count: the given regions, or all that either side spans, without ``collar`` seconds around each end of a reference turn."""
    if regions is None:
        both = reference.select(*keys, "start", "end").unionByName(hypothesis.select(*keys, "start", "end"))
        regions = both.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    mark = lambda df, at, **d: df.select(*keys, at.alias("at"), *(F.lit(d.get(c, 0)).alias(c) for c in ("in", "out")))
    ticks = mark(regions, F.col("start"), **{"in": 1}).unionByName(mark(regions, F.col("end"), **{"in": -1}))
    if collar > 0:
        ends = reference.select(*keys, F.explode(F.array("start", "end")).alias("at"))
        for side in (1, -1):
            ticks = ticks.unionByName(mark(ends, F.col("at") - F.lit(side * collar / 2), out=side))
    return stepped(ticks, keys, ["in", "out"], width).where("`in` > 0 AND `out` = 0").select(*keys, "start", "end")


def diarization_error(reference: DataFrame, hypothesis: DataFrame, keys: list[str], regions: DataFrame | None = None, collar: float = 0.0, width: float = 600.0) -> DataFrame:
    """missed, false_alarm, confusion, total (seconds) and der per file; labels are mapped one to one at best.

    Both sides have start, end and label. Only time in ``regions`` (start, end) counts, and none within ``collar`` / 2 of the ends of
    reference turns. Turns of one label that meet are one. Files that neither side has a turn in within the regions have no row.
    A file's time is cut into parts of ``width`` seconds that any task may take; only the matrix of seconds that a reference label and
    another label share goes to the assignment, a row for each pair of labels.
    """
    reference, hypothesis = (merged(df.where("end > start").select(*keys, "start", "end", "label"), [*keys, "label"]) for df in (reference, hypothesis))
    counted = cut(scored_regions(reference, hypothesis, keys, regions, collar, width))

    def inside(side: DataFrame) -> DataFrame:
        pairs = overlap_join(side, counted, keys, width, float("inf"))
        return pairs.select(*keys, F.col("l_label").alias("label"), F.greatest("l_start", "r_start").alias("start"), F.least("l_end", "r_end").alias("end"))

    refs, hyps = cut(inside(reference)), cut(inside(hypothesis))  # each is read several times below
    mark = lambda df, at, ref, hyp: df.select(*keys, F.col(at).alias("at"), F.lit(ref).alias("refs"), F.lit(hyp).alias("hyps"))
    ticks = mark(refs, "start", 1, 0)
    for df, at, d in ((refs, "end", (-1, 0)), (hyps, "start", (0, 1)), (hyps, "end", (0, -1))):
        ticks = ticks.unionByName(mark(df, at, *d))
    long, more = F.col("end") - F.col("start"), F.col("refs") - F.col("hyps")
    seconds = stepped(ticks, keys, ["refs", "hyps"], width).groupBy(*keys).agg(
        F.sum(long * F.greatest(F.lit(0), more)).alias("missed"), F.sum(long * F.greatest(F.lit(0), -more)).alias("false_alarm"),
        F.sum(long * F.least("refs", "hyps")).alias("_both"), F.sum(long * F.col("refs")).alias("total"),
    )
    pairs = overlap_join(refs, hyps, keys, width, float("inf"))
    shared = pairs.groupBy(*keys, F.col("l_label").alias("ref"), F.col("r_label").alias("hyp")).agg(F.sum(shared_seconds(pairs)).alias("s"))

    def assign(frame: pd.DataFrame) -> pd.DataFrame:
        overlap = dict(zip(zip(frame["hyp"], frame["ref"], strict=True), frame["s"], strict=True))
        right = sum(overlap[pair] for pair in best_mapping(overlap).items())
        return pd.DataFrame([[*(frame[k].iloc[0] for k in keys), float(right)]], columns=[*keys, "_right"])

    kinds = ", ".join(f"{k} {reference.schema[k].dataType.simpleString()}" for k in keys)
    right = shared.groupBy(*keys).applyInPandas(assign, f"{kinds}, _right double")
    out = seconds.join(right, keys, "left").withColumn("confusion", F.col("_both") - F.coalesce("_right", F.lit(0.0)))
    der = F.coalesce(F.try_divide(F.col("missed") + F.col("false_alarm") + F.col("confusion"), "total"), F.lit(float("nan")))
    return out.select(*keys, "missed", "false_alarm", "confusion", "total", der.alias("der"))


def gate_verdict(base: Column, current: Column, direction: Column, abs_tol: Column, rel_tol: Column) -> Column:
    """missing, new, pass, better or worse; the tolerance is the larger of the absolute and the relative one."""
    slack = F.greatest(F.coalesce(abs_tol, F.lit(0.0)), F.coalesce(rel_tol, F.lit(0.0)) * F.abs(base))
    gain = F.when(direction == "lower", base - current).otherwise(current - base)
    return (
        F.when(current.isNull(), "missing").when(base.isNull(), "new").when(gain < -slack, "worse").when(gain > slack, "better").otherwise("pass")
    )


def deltas(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """after - before per key; a side that lacks the key counts as 0."""
    j = before.select(*keys, F.col(value).alias("b")).join(after.select(*keys, F.col(value).alias("a")), keys, "full_outer")
    return j.select(*keys, (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("delta"))


def pair_ratio(runs: DataFrame, pair: str, arm: str, value: str) -> DataFrame:
    """Median over pairs of on / off; pairs whose off side is zero or absent are dropped."""
    p = runs.groupBy(pair).agg(F.max(F.when(F.col(arm) == "on", F.col(value))).alias("on"), F.max(F.when(F.col(arm) == "off", F.col(value))).alias("off"))
    return p.agg(F.median(F.try_divide("on", "off")).alias("ratio"))


def drift(words: DataFrame, bin_seconds: float, least: int = 5) -> DataFrame:
    """Per bin and reference: the commonest label of ``least`` words or more, and whether it differs from the bin before."""
    cell = F.floor(F.col("at") / bin_seconds).cast("long")
    n = words.groupBy("reference", cell.alias("bin"), "label").agg(F.count("*").alias("n"))
    top = n.groupBy("reference", "bin").agg(F.max_by("label", F.when(F.col("label").isNotNull(), F.struct("n", "label"))).alias("label"), F.sum("n").alias("words")).where(F.col("words") >= least)
    before = F.lag("label").over(Window.partitionBy("reference").orderBy("bin"))
    return top.withColumn("swapped", F.coalesce(before != F.col("label"), F.lit(False)))
