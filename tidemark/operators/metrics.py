"""Counters, gauges, histograms and rates over long tables of (series, time, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples of a series that a summary looks at.
RING = 4096
QUANTILES = (0.5, 0.95, 0.99)


def nearest_second(ts: Column) -> Column:
    """The whole second nearest to an instant, halves to the even one."""
    return F.rint(F.unix_micros(ts.cast("timestamp")) / 1e6).cast("long")


def counter_increments(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, process: str) -> DataFrame:
    """``increment`` of a cumulative counter: 0 at a series' first poll, the whole value after a
    change of process or a decrease, else the difference."""
    w = Window.partitionBy(*series).orderBy(*order)
    before, who = F.lag(value).over(w), F.lag(process).over(w)
    first = F.row_number().over(w) == 1
    inc = (
        F.when(first, F.lit(0.0))
        .when(~F.col(process).eqNullSafe(who), F.col(value))
        .when(F.col(value) < before, F.col(value))
        .otherwise(F.col(value) - before)
    )
    return df.withColumn("increment", inc)


def windowed_counts(df: DataFrame, keys: Sequence[str], ts: str, now: Column, window: str, value: Column | None = None) -> DataFrame:
    """Sum of ``value`` (or count) per key at or after ``now`` minus the window."""
    inside = df.where(F.col(ts) >= now - F.expr(f"INTERVAL {window}"))
    total = F.count("*") if value is None else F.sum(value)
    return inside.groupBy(*keys).agg(total.alias("total"))


def ring(df: DataFrame, series: Sequence[str], order: Sequence[Column], n: int = RING) -> DataFrame:
    """The last ``n`` rows of each series; a filter on the row number that Spark pushes below the sort as a group limit."""
    w = Window.partitionBy(*series).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def summary(df: DataFrame, keys: Sequence[str], value: str, every: bool = False) -> DataFrame:
    """count, sum, mean, least, greatest and nearest-rank quantiles: the value at place ceil(q * n).

    Rows without a value are counted only if ``every`` is set; they take no part in the rest.
    """
    q = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(q * 100)}") for q in QUANTILES]
    return df.groupBy(*keys).agg(
        F.count("*" if every else value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("least"),
        F.max(value).alias("greatest"), *q,
    )


def bucket_counts(df: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """Cumulative counts per upper bound, the infinite one included, from one pass."""
    sums = [F.sum((F.col(value) <= b).cast("long")).alias(f"b{k}") for k, b in enumerate(bounds)]
    wide = df.groupBy(*keys).agg(*sums, F.count("*").alias("b_inf"))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("count")) for k, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("b_inf").alias("count")))
    return wide.select(*keys, F.explode(F.array(*rows)).alias("b")).select(*keys, "b.le", F.col("b.count").alias("count"))


def histogram_quantile(buckets: DataFrame, keys: Sequence[str], q: float) -> DataFrame:
    """Linear interpolation inside the bucket in which the q-th observation falls; the highest finite bound if it is the infinite one."""
    w = Window.partitionBy(*keys).orderBy("le")
    every = Window.partitionBy(*keys)
    b = buckets.withColumn("below", F.coalesce(F.lag("count").over(w), F.lit(0))).withColumn(
        "floor", F.coalesce(F.lag("le").over(w), F.lit(0.0))
    )
    b = b.withColumn("rank", F.max("count").over(every) * q)
    hit = b.where((F.col("count") >= F.col("rank")) & (F.col("below") < F.col("rank")))
    inside = F.col("floor") + (F.col("le") - F.col("floor")) * (F.col("rank") - F.col("below")) / (F.col("count") - F.col("below"))
    return hit.select(*keys, F.when(F.col("le") == float("inf"), F.col("floor")).otherwise(inside).alias("quantile"))


def latest(df: DataFrame, keys: Sequence[str], value: str, order: Column) -> DataFrame:
    """Last value of a gauge per series."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def moving_average(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, n: int = 60) -> DataFrame:
    w = Window.partitionBy(*series).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn("moving_average", F.avg(value).over(w))


def rate(increments: DataFrame, keys: Sequence[str], ts: str, seconds: int) -> DataFrame:
    """Increase per second in tumbling windows."""
    return increments.groupBy(*keys, F.window(ts, f"{seconds} seconds").alias("w")).agg(
        (F.sum("increment") / seconds).alias("rate")
    ).select(*keys, F.col("w.start").alias("start"), "rate")


def dropped_periods(begin: Column, end: Column, period: Column) -> Column:
    """Whole periods that a run which took longer than one has skipped."""
    return F.greatest(F.lit(0), F.ceil((end - begin) / period) - 1)


def transitions(df: DataFrame, series: Sequence[str], order: Sequence[str], state: str) -> DataFrame:
    """(from_state, to_state, times): changes of state; the first row of a series is none."""
    w = Window.partitionBy(*series).orderBy(*order)
    moved = df.withColumn("from_state", F.lag(state).over(w)).where(F.col("from_state").isNotNull() & (F.col("from_state") != F.col(state)))
    return moved.groupBy("from_state", F.col(state).alias("to_state")).agg(F.count("*").alias("times"))


def changes(df: DataFrame, series: Sequence[str], order: Sequence[str], state: str) -> DataFrame:
    """Rows whose state differs from the one before, first rows included."""
    w = Window.partitionBy(*series).orderBy(*order)
    return df.withColumn("_before", F.lag(state).over(w)).where(~F.col("_before").eqNullSafe(F.col(state))).drop("_before")


def consecutive(df: DataFrame, series: Sequence[str], order: Sequence[str], failed: Column, least: int) -> DataFrame:
    """Series whose last ``least`` or more rows all failed, with how many."""
    w = Window.partitionBy(*series).orderBy(*order)
    ok = F.sum(F.when(failed, 0).otherwise(1)).over(w)
    runs = df.withColumn("_ok", ok).withColumn("_last", F.max("_ok").over(Window.partitionBy(*series)))
    tail = runs.where((F.col("_ok") == F.col("_last")) & failed)
    return tail.groupBy(*series).agg(F.count("*").alias("failures")).where(F.col("failures") >= least)


def strict_sum(value: str) -> Column:
    """Sum that is unknown if any part is."""
    return F.when(F.count(value) == F.count("*"), F.sum(value))
