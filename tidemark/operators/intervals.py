"""Interval algebra over start and end columns. Three overlap rules are kept apart on purpose.

A null end means open: it counts as beyond every instant. Joins on overlap go through buckets: both
sides are exploded to the buckets they touch and equi-joined on key and bucket; a pair is reported
in the first bucket it shares, so no distinct is needed. Long intervals raise the bucket count, so
pick a width near the usual length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def _open(end: Column) -> Column:
    return F.coalesce(end, F.lit(float("inf")))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open: they share more than a boundary."""
    return (a_start < _open(b_end)) & (b_start < _open(a_end))


def overlaps_closed(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Closed: a shared boundary is enough, as list endpoints ask for."""
    return (a_start <= _open(b_end)) & (b_start <= _open(a_end))


def active_at(start: Column, end: Column, now: Column) -> Column:
    """start <= now < end."""
    return (start <= now) & (now < _open(end))


def _bucketed(df: DataFrame, start: str, end: str, width: float) -> DataFrame:
    last = F.greatest(F.col(start), F.col(end) - F.lit(1e-9))
    lo, hi = F.floor(F.col(start) / width), F.floor(last / width)
    return df.withColumn("_lo", lo).withColumn("_bucket", F.explode(F.sequence(lo, hi)))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], width: float, horizon: float) -> DataFrame:
    """Pairs of one key that overlap half-open. Left columns are prefixed l_, right ones r_; both have start, end.

    Null ends become ``horizon`` in the result. Open intervals do not go through buckets, of which
    they would touch all to the end of time: they meet what ends after they begin by the key alone.
    """
    sides = []
    for df, p in ((left, "l_"), (right, "r_")):
        named = {c: p + c for c in df.columns if c not in keys}
        shut = _bucketed(df.where("end is not null"), "start", "end", width).withColumnsRenamed(named | {"_lo": p + "_lo"})
        open_ = df.where("end is null").withColumn("end", F.lit(horizon)).withColumnsRenamed(named)
        sides.append((shut, open_, df.withColumn("end", F.coalesce("end", F.lit(horizon))).withColumnsRenamed(named)))
    (l_shut, l_open, l_all), (r_shut, r_open, _) = sides
    hit = (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end"))
    first = F.col("_bucket") == F.greatest("l__lo", "r__lo")
    out = l_shut.join(r_shut, [*keys, "_bucket"]).where(first & hit).drop("_bucket", "l__lo", "r__lo")
    for a, b in ((l_open, r_shut.where(F.col("_bucket") == F.col("r__lo")).drop("_bucket", "r__lo")), (l_all, r_open)):
        out = out.unionByName(a.join(b, list(keys)).where(hit))
    return out


def shared_seconds(pairs: DataFrame) -> Column:
    """Overlap length of a row of ``overlap_join``."""
    return F.least("l_end", "r_end") - F.greatest("l_start", "r_start")


def coverage(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Seconds of overlap per key."""
    return pairs.groupBy(*keys).agg(F.sum(shared_seconds(pairs)).alias("seconds"))


def best_overlap(pairs: DataFrame, keys: Sequence[str], label: str, order: str) -> DataFrame:
    """Label that overlaps a key the most; of equals the one first by ``order``."""
    got = pairs.groupBy(*keys, label).agg(F.sum(shared_seconds(pairs)).alias("s"), F.min(order).alias("o"))
    return got.groupBy(*keys).agg(F.max_by(label, F.struct("s", -F.col("o"))).alias(label), F.max("s").alias("seconds"))


def merged(df: DataFrame, keys: Sequence[str], gap: float = 0.0) -> DataFrame:
    """Union of the intervals of a key; gaps up to ``gap`` are closed."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    seen = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(seen.isNull() | (F.col("start") > seen + gap), 1).otherwise(0)
    islands = df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def free_slots(windows: DataFrame, blockers: DataFrame, keys: Sequence[str], least: float = 60.0, width: float = 7 * 86_400.0) -> DataFrame:
    """Each window (uid, start, end) minus the union of the blockers of its key; gaps shorter than ``least`` are dropped.

    One sort: windows and clipped blockers of a window form one sequence whose gaps are the slots.
    """
    w = windows.withColumnsRenamed({"start": "w_start", "end": "w_end"})
    pairs = overlap_join(windows, merged(blockers, keys), keys, width, float("inf"))
    rest = {f"l_{c}": c for c in windows.columns if c not in (*keys, "start", "end")}
    clipped = pairs.withColumnsRenamed({"l_start": "w_start", "l_end": "w_end", "r_start": "start", "r_end": "end"} | rest)
    clipped = clipped.withColumn("start", F.greatest("start", "w_start")).withColumn("end", F.least("end", "w_end"))
    begin = w.withColumn("start", F.col("w_start")).withColumn("end", F.col("w_start"))
    finish = w.withColumn("start", F.col("w_end")).withColumn("end", F.col("w_end"))
    points = clipped.unionByName(begin).unionByName(finish)
    order = Window.partitionBy(*keys, "uid").orderBy("start", "end")
    seen = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gaps = points.withColumn("slot_start", seen).where(F.col("start") - F.col("slot_start") >= least)
    return gaps.select(*keys, "uid", "slot_start", F.col("start").alias("slot_end"))


def stepped(ticks: DataFrame, keys: Sequence[str], sums: Sequence[str], width: float) -> DataFrame:
    """Elementary intervals (start, end) of a key from ticks (at, changes), with the running sums of the changes.

    A key's time is cut into parts of ``width``; parts are summed and put in order first, and each then
    runs by itself from what came before it, so a long timeline is many tasks.
    """
    changes = ticks.groupBy(*keys, "at").agg(*(F.sum(c).alias(c) for c in sums)).withColumn("_part", F.floor(F.col("at") / width))
    by_part = Window.partitionBy(*keys).orderBy("_part")
    so_far = by_part.rowsBetween(Window.unboundedPreceding, -1)
    parts = changes.groupBy(*keys, "_part").agg(F.min("at").alias("_first"), *(F.sum(c).alias(c) for c in sums))
    parts = parts.select(*keys, "_part", F.lead("_first").over(by_part).alias("_next"), *(F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(f"_{c}") for c in sums))
    inside = Window.partitionBy(*keys, "_part").orderBy("at")
    rows = changes.join(parts, [*keys, "_part"])
    out = rows.select(*keys, F.col("at").alias("start"), F.coalesce(F.lead("at").over(inside), "_next").alias("end"), *((F.col(f"_{c}") + F.sum(c).over(inside)).alias(c) for c in sums))
    return out.where("end is not null")


def sweep(df: DataFrame, keys: Sequence[str], width: float = 30 * 86_400.0) -> DataFrame:
    """Elementary intervals of a key and how many intervals cover each."""
    ticks = df.select(*keys, F.col("start").alias("at"), F.lit(1).alias("depth")).unionByName(df.select(*keys, F.col("end").alias("at"), F.lit(-1).alias("depth")))
    return stepped(ticks, keys, ["depth"], width).where("depth > 0").select(*keys, "start", "end", "depth")


def overlap_seconds(df: DataFrame, keys: Sequence[str], least: int = 2) -> DataFrame:
    """Seconds in which ``least`` or more intervals run at once."""
    return sweep(df, keys).where(F.col("depth") >= least).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("seconds"))


def clipped(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Intervals cut to [start, end); what falls outside goes."""
    out = df.withColumn("start", F.greatest(F.col("start"), start)).withColumn("end", F.least(F.coalesce("end", end), end))
    return out.where("start < end")


def exclusive_runs(df: DataFrame, keys: Sequence[str], label: str, gap: float, least: float) -> DataFrame:
    """Stretches of one label alone, joined over gaps up to ``gap``, of ``least`` or longer."""
    named = df.select(*keys, label).distinct().withColumn("_name", F.xxhash64(label).cast("decimal(38,0)"))
    d = lambda at, sign: df.select(*keys, F.col(at).alias("at"), F.lit(sign).alias("d"), (F.xxhash64(label).cast("decimal(38,0)") * sign).cast("decimal(38,0)").alias("h"))
    ticks = d("start", 1).unionByName(d("end", -1)).groupBy(*keys, "at").agg(F.sum("d").alias("d"), F.sum("h").alias("h"))
    order = Window.partitionBy(*keys).orderBy("at")
    cells = ticks.select(*keys, F.col("at").alias("start"), F.lead("at").over(order).alias("end"), F.sum("d").over(order).alias("depth"), F.sum("h").over(order).alias("_name"))
    # where one interval runs, the running sum of names is its own
    own = cells.where("depth = 1 and end is not null").join(named, [*keys, "_name"]).select(*keys, label, "start", "end")
    return merged(own, [*keys, label], gap).where(F.col("end") - F.col("start") >= least)


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str]) -> DataFrame:
    """Left rows with the right row of their key that is latest at or before them; one union and one window, no range join."""
    tagged = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType))
    other = right.select(*keys, ts, F.struct(*values).alias("_v"))
    for c in left.columns:
        if c not in (*keys, ts):
            other = other.withColumn(c, F.lit(None).cast(left.schema[c].dataType))
    rows = tagged.unionByName(other.withColumn("_side", F.lit(0)))
    w = Window.partitionBy(*keys).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return seen.select(*left.columns, *(F.col(f"_v.{v}").alias(f"asof_{v}") for v in values))


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], label: str, within: float, width: float, horizon: float) -> DataFrame:
    """Label of the nearest right interval whose gap to the left one is at most ``within``; overlap wins by length."""
    wide = right.withColumn("start", F.col("start") - within).withColumn("end", F.coalesce("end", F.lit(horizon)) + within)
    pairs = overlap_join(left, wide, keys, width, horizon + 2 * within)
    gap = F.greatest(F.col("r_start") + within - F.col("l_end"), F.col("l_start") - (F.col("r_end") - within))
    return pairs.withColumn("gap", gap).groupBy(*keys, "l_uid").agg(F.min_by(F.col(f"r_{label}"), F.struct("gap", "r_start")).alias(label))
