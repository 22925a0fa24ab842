"""Writes spared: of a key's touches, those that come an interval or more after the last one written."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder of the session; a local session that names none gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = context.getConf().get("spark.checkpoint.dir")
        if where is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        context.setCheckpointDir(where or tempfile.mkdtemp())
    return df.checkpoint()


def following(touches: DataFrame, key: str, at: str, interval: float, part: float) -> DataFrame:
    """(key, at, next): each distinct touch with the first one ``interval`` or more after it, null for none.

    Touches and the instants from which the next may come are one sequence, backwards; a key's time is cut into parts of ``part``
    seconds, and what is not met in a part is the first touch of the next part that has any.
    """
    rows = touches.where(F.col(at).isNotNull()).select(key, F.col(at).cast("double").alias("at")).distinct()
    asks = rows.select(key, (F.col("at") + interval).alias("t"), "at", F.lit(1).alias("asks"))
    all_ = rows.select(key, F.col("at").alias("t"), "at", F.lit(0).alias("asks")).unionByName(asks).withColumn("_part", F.floor(F.col("t") / part))
    firsts = all_.groupBy(key, "_part").agg(F.min(F.when(F.col("asks") == 0, F.col("t"))).alias("_first"))
    later = Window.partitionBy(key).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select(key, "_part", F.last("_first", ignorenulls=True).over(later).alias("_later"))
    back = Window.partitionBy(key, "_part").orderBy(F.desc("t"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    met = F.last(F.when(F.col("asks") == 0, F.col("t")), ignorenulls=True).over(back)
    return all_.withColumn("_met", met).where("asks = 1").join(firsts, [key, "_part"]).select(key, "at", F.coalesce("_met", "_later").alias("next"))


def coalesced(touches: DataFrame, key: str, at: str, interval: float, part: float | None = None) -> DataFrame:
    """(key, last_seen): the writes that a key's touches (key, at in seconds) lead to: the first, and each first one ``interval`` after the write before.

    Which touch is written depends on all before it, but each knows who would be next. Pointers are doubled until none leads on, then
    the first touch follows them back from the longest: a chain of n writes takes log2(n) joins, on keys that are all different.
    """
    steps = [cut(following(touches, key, at, interval, part or 1024 * interval))]
    while not (longer := steps[-1].where("next is not null")).isEmpty():
        to = steps[-1].select(key, F.col("at").alias("next"), F.col("next").alias("_next"))
        steps.append(cut(longer.join(to, [key, "next"]).select(key, "at", F.col("_next").alias("next"))))
    chosen = steps[0].groupBy(key).agg(F.min("at").alias("at"))
    for step in reversed(steps[:-1]):
        on = step.where("next is not null")
        chosen = cut(chosen.unionByName(chosen.join(on, [key, "at"]).select(key, F.col("next").alias("at"))))
    return chosen.select(key, F.col("at").alias("last_seen"))


def online(last_seen: Column, now: Column, ttl: float) -> Column:
    """Seen within ``ttl`` seconds; never seen is offline."""
    return F.coalesce(now - last_seen <= ttl, F.lit(False))
