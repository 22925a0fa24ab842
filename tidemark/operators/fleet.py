"""Fleet snapshots: live members, provider merges, stage graphs, statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.presence import cut

#: Heartbeats, seconds, and how many of them a member may miss.
HEARTBEAT = {"node": 2, "host": 5}
MISSES = 5
LOSS_SECONDS = 5.0
BUSY = 0.85
STATUS_RANK = {"ok": 0, "degraded": 1, "down": 2, "unknown": 3}


def live(index: DataFrame, values: DataFrame, member: str, score: str, now: Column, ttl: float) -> DataFrame:
    """Members whose heartbeat is not older than ``ttl``, with their values; those without one are left out."""
    return index.where(F.col(score) >= now - F.lit(ttl)).join(values, member)


def parsed(df: DataFrame, raw: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a typed ``body``, rows that do not parse)."""
    wide = schema + ", _bad string"
    body = df.withColumn("body", F.from_json(raw, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("body").isNull() | F.col("body._bad").isNotNull()
    return body.where(~bad).withColumn("body", F.col("body").dropFields("_bad")), body.where(bad).drop("body")


def merge_providers(hosts: DataFrame) -> DataFrame:
    """Per provider: sessions added up, the best status of its hosts, host names, capacity unless one is unknown."""
    rank = F.create_map(*(x for k, v in STATUS_RANK.items() for x in (F.lit(k), F.lit(v))))[F.col("status")]
    names = F.create_map(*(x for k, v in STATUS_RANK.items() for x in (F.lit(v), F.lit(k))))
    out = hosts.withColumn("_rank", rank).groupBy("provider").agg(
        F.sum("sessions").alias("sessions"), F.min("_rank").alias("_rank"), F.sort_array(F.collect_set("host")).alias("hosts"),
        F.when(F.count("capacity") == F.count("*"), F.sum("capacity")).alias("capacity"),
    )
    return out.withColumn("status", names[F.col("_rank")]).drop("_rank")


def capacity_status(live_count: Column, capacity: Column) -> Column:
    return (
        F.when(capacity.isNull(), "unknown").when(live_count > capacity, "crit").when(live_count >= capacity * BUSY, "warn").otherwise("good")
    )


def audio_status(silent: Column, clipping: Column, level: Column, snr: Column) -> Column:
    """First of: silence or clipping, weak level or noise, good; unknown without a level."""
    return (
        F.when(silent | (clipping >= 0.01), "crit").when(level.isNull(), "unknown").when((level < -45) | (snr < 10), "warn").otherwise("good")
    )


def readiness(workers: DataFrame, limit: float) -> DataFrame:
    """not_ready without workers or with a dead one; degraded if every one is saturated; else ready."""
    full = (F.col("utilization") >= limit) & (F.col("live_jobs") > 0)
    n = workers.agg(F.count("*").alias("n"), F.count_if(~F.col("alive")).alias("dead"), F.count_if(full).alias("full"))
    return n.withColumn("state", F.when((F.col("n") == 0) | (F.col("dead") > 0), "not_ready").when(F.col("full") == F.col("n"), "degraded").otherwise("ready"))


def stage_depths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(stage, depth): longest path from a source. Stages of a cycle, which no round settles, come last with a null depth.

    A stage settles when all its inputs have; the rounds are as many as the graph is deep. A round
    joins only the edges that leave the stages which the last one settled.
    """
    need = edges.select("child", "parent").distinct()
    wait = need.groupBy(F.col("child").alias("stage")).agg(F.count("*").alias("left"))
    state = nodes.select("stage").join(wait, "stage", "left").select("stage", F.coalesce("left", F.lit(0)).alias("left"), F.lit(None).cast("int").alias("depth"))
    state = cut(state)
    level = 1
    while not state.where("depth is null and left = 0").isEmpty():
        ready = state.where("depth is null and left = 0").select(F.col("stage").alias("parent"))
        served = need.join(ready, "parent").groupBy(F.col("child").alias("stage")).agg(F.count("*").alias("got"))
        depth = F.when(F.col("depth").isNull() & (F.col("left") == 0), level).otherwise(F.col("depth"))
        after = state.join(served, "stage", "left").select("stage", (F.col("left") - F.coalesce("got", F.lit(0))).alias("left"), depth.alias("depth"))
        state, level = cut(after), level + 1  # a round reads only what the last one wrote
    return nodes.join(state.select("stage", "depth"), "stage", "left")


def stage_edges(stages: DataFrame) -> DataFrame:
    """Edges of stages (stage, inputs, seconds, gate) with what became of the audio between them."""
    s = stages.withColumn("input", F.explode("inputs"))
    j = s.join(stages.select(F.col("stage").alias("input"), F.col("seconds").alias("before")), "input")
    lost = F.col("before") - F.col("seconds")
    kind = F.when(F.col("gate"), "gated").when(lost > LOSS_SECONDS, "loss").otherwise("within_tolerance")
    return j.select("input", "stage", lost.alias("lost"), kind.alias("kind"))


def handshake_tally(df: DataFrame, keys: list[str], reason: str, n: str, ok: str = "ok") -> DataFrame:
    """Attempts, failures and their share; null without attempts."""
    fail = F.sum(F.when(F.col(reason) != ok, F.col(n)).otherwise(0))
    out = df.groupBy(*keys).agg(F.sum(n).alias("attempts"), fail.alias("failures"))
    return out.withColumn("failure_ratio", F.try_divide("failures", "attempts"))


def closed_set(value: Column, allowed: list[str]) -> Column:
    return F.when(value.isin(allowed), value).otherwise("other")


def freshness(last_success: Column, now: Column, warn: float, crit: float) -> Column:
    """never, good, warn or crit by the age of the last success."""
    age = now - last_success
    return F.when(last_success.isNull(), "never").when(age >= crit, "crit").when(age >= warn, "warn").otherwise("good")


def least_utilised(workers: DataFrame, tags: list[str]) -> DataFrame:
    """The live worker that holds every tag and is used least; ties to the smaller id."""
    has = F.array_contains("tags", tags[0]) if tags else F.lit(True)
    for t in tags[1:]:
        has = has & F.array_contains("tags", t)
    return workers.where(has & F.col("alive")).agg(F.min_by("worker_id", F.struct("utilization", "worker_id")).alias("worker_id"))


def earliest_deadline(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """The ready job with the earliest deadline, the first one of equals."""
    return jobs.where("state = 'READY'").groupBy(*keys).agg(F.min_by("job_id", F.struct("deadline", "seq")).alias("job_id"))


def clock_offset(samples: DataFrame, keys: list[str], order: str, keep: int = 8) -> DataFrame:
    """Offset of the sample with the smallest round trip among the last ``keep``; negative trips do not count."""
    from tidemark.operators.metrics import ring

    good = samples.where("rtt >= 0")
    return ring(good, keys, [F.col(order).desc()], keep).groupBy(*keys).agg(F.min_by("offset", F.struct("rtt", -F.col(order))).alias("offset"))
