"""Sessions that a worker can hold, measured from its single executions.

A sliding window of event time holds a worker's newest executions. A window is clean if it leaves the
worker some idle time and few periods were dropped: only such a window says what a session costs, since
a worker that is overrun drops the very work that would show it. The ceiling is the share of time that
may be busy over the last trusted cost, so a window that is not clean can never raise it. Executions
at the start of a job pay for its start and are left out; few clean windows measure nothing; a pin wins.

The batch is window functions alone: a worker's time is cut into parts that see one window back, and
what must be carried over parts (the last cost, the number of clean windows, the newest completion) is
folded over one row a part. ``Sliding`` is the same for one execution after the other, as a stream needs it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """``window`` in seconds; ``part`` how much of a worker's time one task takes, a window at least."""

    target: float = 0.85
    window: float = 60.0
    warm_up: int = 3
    busy: float = 0.9
    dropped: float = 0.5
    samples: int = 5
    least: int = 1
    pin: int | None = None
    part: float = 3600.0


#: What orders executions of a job that complete at one instant.
TIES = ("start", "seconds", "dropped")


def retained(executions: DataFrame, limits: Limits) -> DataFrame:
    """Executions that count: not the first ``warm_up`` of a job, nor of one that comes back after the worker has moved on by a window without it."""
    part = max(limits.part, limits.window)
    rows = executions.withColumn("_part", F.floor(F.col("complete") / part))
    newest = rows.groupBy("worker", "_part").agg(F.max("complete").alias("_last"))
    earlier = F.max("_last").over(Window.partitionBy("worker").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(newest.select("worker", "_part", earlier.alias("_earlier")), ["worker", "_part"])
    before = F.coalesce(F.lag("complete").over(Window.partitionBy("worker", "_part").orderBy("complete", "job", *TIES)), "_earlier")
    rows = rows.withColumn("_before", before)
    job = Window.partitionBy("worker", "job").orderBy("complete", *TIES)
    last = F.lag("complete").over(job)
    begins = F.when(last.isNull() | (F.col("_before") - limits.window > last), 1).otherwise(0)
    rows = rows.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(job))
    nth = F.row_number().over(Window.partitionBy("worker", "job", "_run").orderBy("complete", *TIES))
    return rows.withColumn("_nth", nth).where(F.col("_nth") > limits.warm_up).drop("_earlier", "_before", "_begins", "_run", "_nth")


def learned(executions: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(worker, job, complete, busy, drop_share, clean, cost, ceiling, capacity) after each execution that counts.

    ``executions``: worker, job, start, complete, seconds, dropped. Executions of a worker that complete at one instant are seen together.
    """
    limits = limits or Limits()
    part = max(limits.part, limits.window)
    rows = retained(executions, limits)
    # a part also sees what the one before it ends with
    over = F.explode(F.when((F.col("_part") + 1) * part - limits.window <= F.col("complete"), F.array("_part", F.col("_part") + 1)).otherwise(F.array("_part")))
    seen = rows.withColumn("_own", F.col("_part")).withColumn("_part", over)
    seen = seen.withColumn("_us", F.round(F.col("complete") * 1_000_000).cast("long"))
    order = Window.partitionBy("worker", "_part").orderBy("_us")
    recent = order.rangeBetween(-round(limits.window * 1_000_000), 0)
    n, jobs = F.count("*").over(recent), F.size(F.collect_set("job").over(recent))
    span = F.col("complete") - F.min("start").over(recent)
    dropped = F.sum("dropped").over(recent)
    seen = seen.withColumn("_jobs", jobs).withColumn("busy", F.when((n >= 2) & (span > 0), F.least(F.lit(1.0), F.sum("seconds").over(recent) / span))).withColumn("drop_share", dropped / (dropped + n))
    own = seen.where(F.col("_own") == F.col("_part"))
    own = own.withColumn("clean", F.coalesce((F.col("busy") < limits.busy) & (F.col("drop_share") < limits.dropped), F.lit(False)))
    own = own.withColumn("_cost", F.when(F.col("clean") & (F.col("busy") > 0), F.col("busy") / F.col("_jobs")))
    parts = own.groupBy("worker", "_part").agg(F.max_by("_cost", F.when(F.col("_cost").isNotNull(), F.col("complete"))).alias("_c"), F.count_if("clean").alias("_n"))
    earlier = Window.partitionBy("worker").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("worker", "_part", F.last("_c", ignorenulls=True).over(earlier).alias("_c"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"))
    upto = order.rangeBetween(Window.unboundedPreceding, 0)
    own = own.join(parts, ["worker", "_part"])
    own = own.withColumn("cost", F.coalesce(F.last("_cost", ignorenulls=True).over(upto), "_c")).withColumn("_clean", F.col("_n") + F.count_if("clean").over(upto))
    ceiling = F.when(F.col("cost") > 0, F.floor(F.lit(limits.target) / F.col("cost")))
    capacity = F.when(F.col("_clean") >= limits.samples, F.greatest(F.lit(limits.least), ceiling)) if limits.pin is None else F.lit(limits.pin)
    return own.withColumn("ceiling", ceiling).select("worker", "job", "complete", "busy", "drop_share", "clean", "cost", "ceiling", F.when(F.lit(limits.pin is not None) | ceiling.isNotNull(), capacity).cast("long").alias("capacity"))


@dataclass
class Sliding:
    """One worker's window, one instant's executions after the other's. All of it is bounded by the window."""

    limits: Limits = field(default_factory=Limits)
    kept: list[tuple[str, float, float, float, float]] = field(default_factory=list)  # job, start, complete, seconds, dropped
    jobs: dict[str, tuple[int, float]] = field(default_factory=dict)  # executions so far, the last completion
    newest: float = -math.inf
    clean: int = 0
    cost: float | None = None

    def take(self, instant: list[tuple[str, float, float, float, float]]) -> list[tuple]:
        """(job, complete, busy, drop_share, clean, cost, ceiling, capacity) of the executions of one instant that count."""
        r, now = self.limits, instant[0][2]
        added = []
        for e in sorted(instant, key=lambda e: (e[0], e[1], e[3], e[4])):
            self.jobs = {j: v for j, v in self.jobs.items() if v[1] >= self.newest - r.window}
            n = self.jobs.get(e[0], (0, 0.0))[0] + 1
            self.jobs[e[0]] = (n, now)
            self.newest = now
            if n > r.warm_up:
                added.append(e)
        self.kept = [e for e in self.kept if e[2] >= now - r.window] + added
        if not added:
            return []
        span = now - min(e[1] for e in self.kept)
        busy = min(1.0, sum(e[3] for e in self.kept) / span) if len(self.kept) >= 2 and span > 0 else None
        lost = sum(e[4] for e in self.kept)
        share = lost / (lost + len(self.kept))
        good = busy is not None and busy < r.busy and share < r.dropped
        if good:
            self.clean += len(added)
            if busy > 0:
                self.cost = busy / len({e[0] for e in self.kept})
        ceiling = math.floor(r.target / self.cost) if self.cost else None
        capacity = r.pin if r.pin is not None else max(r.least, ceiling) if ceiling is not None and self.clean >= r.samples else None
        return [(e[0], now, busy, share, good, self.cost, ceiling, capacity) for e in added]
