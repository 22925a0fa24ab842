"""Rolling audio windows from block summaries, and bounded buffers that return what does not fit.

A series comes as chunks of samples of any size. They are cut at fixed places into blocks, and a block
is summarised once: its size, sum of squares, peak, and its runs at the rail (how many samples stand in
runs, and how long the runs at both ends are). Summaries merge associatively, so a window of ten
seconds is ten rows and not its samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.audio import dbfs

#: What counts as the rail, and samples that must stand there in a row.
RAIL, RUN = 0.99, 2


def placed(chunks: DataFrame, keys: Sequence[str], order: str, samples: str) -> DataFrame:
    """``chunks`` with begin, the number of samples of the series before each."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("begin", F.coalesce(F.sum(F.greatest(F.size(samples), F.lit(0))).over(before), F.lit(0)).cast("long"))


def blocks(chunks: DataFrame, keys: Sequence[str], order: str, samples: str, size: int) -> DataFrame:
    """(block, samples) of each series: its samples in blocks of ``size``, the last one perhaps shorter."""
    rows = placed(chunks, keys, order, samples).where(F.size(samples) > 0)
    end = F.col("begin") + F.size(samples)
    rows = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / size), F.floor((end - 1) / size))))
    start = F.greatest(F.col("begin"), F.col("block") * size)
    stop = F.least(end, (F.col("block") + 1) * size)
    piece = F.slice(samples, (start - F.col("begin") + 1).cast("int"), (stop - start).cast("int"))
    parts = rows.select(*keys, "block", start.alias("_at"), piece.alias("_piece")).groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("_at", "_piece"))).alias("_p"))
    return parts.select(*keys, "block", F.flatten(F.transform("_p", lambda p: p["_piece"])).alias("samples"))


def _charged(run: Column) -> Column:
    return F.when(run >= RUN, run).otherwise(0)


def summary(samples: Column) -> Column:
    """struct(n, squares, peak, head, tail, charged) of a block, from one pass over it."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("squares"), F.lit(0.0).alias("peak"), F.lit(0).alias("head"), F.lit(0).alias("tail"), F.lit(0).alias("charged"))

    def step(s: Column, v: Column) -> Column:
        x = v.cast("double")
        run = F.when(F.abs(x) >= RAIL, s["tail"] + 1).otherwise(0)
        more = F.when(run == RUN, RUN).when(run > RUN, 1).otherwise(0)
        return F.struct(
            (s["n"] + 1).alias("n"), (s["squares"] + x * x).alias("squares"), F.greatest(s["peak"], F.abs(x)).alias("peak"),
            F.when(run > s["n"], run).otherwise(s["head"]).alias("head"), run.alias("tail"), (s["charged"] + more).alias("charged"),
        )

    return F.aggregate(samples, zero, step)


def joined(a: Column, b: Column) -> Column:
    """The summary of two blocks that follow each other."""
    whole = lambda s, end: s[end] == s["n"]
    seam = a["tail"] + b["head"]
    return F.struct(
        (a["n"] + b["n"]).alias("n"), (a["squares"] + b["squares"]).alias("squares"), F.greatest(a["peak"], b["peak"]).alias("peak"),
        F.when(whole(a, "head"), a["n"] + b["head"]).otherwise(a["head"]).alias("head"), F.when(whole(b, "tail"), b["n"] + a["tail"]).otherwise(b["tail"]).alias("tail"),
        (a["charged"] + b["charged"] - _charged(a["tail"]) - _charged(b["head"]) + _charged(seam)).alias("charged"),
    )


def meter(chunks: DataFrame, keys: Sequence[str], order: str, samples: str, block: int, window: int, silence: float = 0.01, quantile: float = 0.1) -> DataFrame:
    """(block, seconds' end) snapshots: rms_db, peak_db, clipped, silent and floor_db over the ``window`` newest blocks at each block's end.

    ``clipped`` is the share of samples in runs at the rail; ``floor_db`` a low quantile, interpolated, of the blocks' levels, and the level
    itself below two whole blocks. A last block that is not whole has a snapshot only while the window still begins with the series.
    """
    rows = blocks(chunks, keys, order, samples, block).withColumn("s", summary(F.col("samples"))).drop("samples")
    rows = rows.where((F.col("s.n") == block) | (F.col("block") < window))
    recent = F.collect_list("s").over(Window.partitionBy(*keys).orderBy("block").rowsBetween(1 - window, 0))
    rows = rows.withColumn("_all", recent)
    first = F.element_at("_all", 1)
    all_ = F.aggregate(F.slice("_all", 2, window), first, joined)
    rows = rows.withColumn("w", all_)
    level = lambda s: dbfs(F.sqrt(s["squares"] / s["n"]))
    levels = F.sort_array(F.transform(F.filter("_all", lambda s: s["n"] == block), level))
    at = (F.size("_l") - 1) * F.lit(quantile)
    lo = F.floor(at).cast("int")
    a, b = F.element_at("_l", lo + 1), F.element_at("_l", F.least(lo + 2, F.size("_l")))
    rms = level(F.col("w"))
    rows = rows.withColumn("_l", levels).withColumn("rms_db", rms)
    return rows.select(
        *keys, "block", F.col("w.n").alias("n"), "rms_db", dbfs(F.col("w.peak")).alias("peak_db"), (F.col("w.charged") / F.col("w.n")).alias("clipped"),
        (F.col("rms_db") <= dbfs(F.lit(float(silence)))).alias("silent"), F.when(F.size("_l") < 2, F.col("rms_db")).otherwise(a + (b - a) * (at - lo)).alias("floor_db"),
    )


def filled(chunks: DataFrame, keys: Sequence[str], order: str, samples: str, capacity: int) -> DataFrame:
    """``chunks`` with kept and overflow: a buffer takes what still fits and gives the rest back. Both sides together are the input."""
    room = F.greatest(F.lit(0), F.least(F.size(samples), (F.lit(capacity) - F.col("begin")).cast("int")))
    rows = placed(chunks, keys, order, samples).withColumn("_room", room)
    kept, rest = F.slice(samples, 1, F.col("_room")), F.slice(samples, F.col("_room") + 1, F.size(samples))
    return rows.withColumn("kept", kept).withColumn("overflow", rest).drop("_room", "begin")


def rolled(chunks: DataFrame, keys: Sequence[str], order: str, samples: str, capacity: int) -> DataFrame:
    """``chunks`` with kept and overflow of a buffer that pushes its oldest samples out: the newest ``capacity`` of a series are kept."""
    total = F.sum(F.greatest(F.size(samples), F.lit(0))).over(Window.partitionBy(*keys))
    out = F.greatest(F.lit(0), F.least(F.size(samples), (total - capacity - F.col("begin")).cast("int")))
    rows = placed(chunks, keys, order, samples).withColumn("_out", out)
    return rows.withColumn("overflow", F.slice(samples, 1, F.col("_out"))).withColumn("kept", F.slice(samples, F.col("_out") + 1, F.size(samples))).drop("_out", "begin")
