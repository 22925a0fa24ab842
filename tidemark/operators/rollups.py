"""Rollups of nodes, hosts, stages and jobs: findings, totals, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.metrics import ring, summary

#: Share of rejected handshakes worth naming, suffix of diarization labels, retained samples of a process and a session.
REJECT_RATIO = 0.5
DIARIZATION = ":diarization"
PROCESS_SAMPLES, SESSION_SAMPLES = 4096, 512
#: Fixed value: clean samples before a capacity counts as measured.
CLEAN_SAMPLES = 5


def node_findings(nodes: DataFrame) -> DataFrame:
    """node, id, level of what is wrong with a node.

    ``nodes`` has node, successes, failures, invalid (of the failures), dominant (the reason of most of
    them) and ended (registrations for ended sessions). A node that never accepted a token is an
    error, whose cause is the signing key if every failure is an invalid token.
    """
    fails, good = F.col("failures"), F.col("successes")
    ratio = F.try_divide(fails, fails + good)
    never, many = (fails > 0) & (good == 0), (good > 0) & (fails > 0) & (ratio >= REJECT_RATIO)
    finding = lambda on, name, level, why: F.when(on, F.struct(F.lit(name).alias("id"), F.lit(level).alias("level"), why.alias("cause")))
    key = F.when(F.col("invalid") == fails, "signing-key").otherwise(F.coalesce("dominant", F.lit("rejected")))
    all_ = F.array_compact(F.array(
        finding(never, "auth-never-succeeded", "error", key), finding(many, "auth-reject-ratio", "warning", F.round(ratio * 100).cast("int").cast("string")),
        finding(F.coalesce("ended", F.lit(0)) > 0, "ended-session-registrations", "warning", F.col("ended").cast("string")),
    ))
    return nodes.select("node", F.explode(all_).alias("f")).select("node", "f.*")


def host_findings(hosts: DataFrame) -> DataFrame:
    """Hosts (host, rejects, providers) that refused a provider key, with the keys they serve."""
    keys = F.array_join(F.array_sort("providers"), ", ")
    bad = hosts.where("rejects > 0")
    return bad.select("host", F.lit("invalid-provider-key").alias("id"), F.lit("error").alias("level"), F.when(keys == "", "(none configured)").otherwise(keys).alias("cause"))


def diagnostics_rollup(nodes: DataFrame, closes: DataFrame, hosts: DataFrame) -> DataFrame:
    """One row of fleet totals. ``closes`` has role and n."""
    n = nodes.agg(
        F.count("*").alias("nodes"), F.coalesce(F.sum("successes"), F.lit(0)).alias("auth_success"), F.coalesce(F.sum("failures"), F.lit(0)).alias("auth_failure"),
        F.coalesce(F.sum("timeouts"), F.lit(0)).alias("auth_timeouts"),
    )
    c = closes.agg(
        F.coalesce(F.sum(F.when(F.col("role") == "source", F.col("n"))), F.lit(0)).alias("source_closes"),
        F.coalesce(F.sum(F.when(F.col("role") != "source", F.col("n"))), F.lit(0)).alias("client_closes"),
    )
    found = node_findings(nodes).select("id").unionByName(host_findings(hosts).select("id")).agg(F.count("*").alias("findings"))
    h = hosts.agg(F.count("*").alias("hosts"))
    return n.crossJoin(h).crossJoin(c).crossJoin(found)  # one row each


def stages_by_depth(stages: DataFrame, key: str) -> DataFrame:
    """Stages (key, stage, depth) of each depth in order of their names."""
    return stages.groupBy(key, "depth").agg(F.sort_array(F.collect_list("stage")).alias("stages"))


def first_stage(stages: DataFrame, key: str, on: Column, value: str | Column) -> DataFrame:
    """Of the stages that meet ``on``, the one nearest the source, the first by name of equals, and its ``value``."""
    place = F.struct("depth", "stage")
    return stages.where(on).groupBy(key).agg(F.min_by("stage", place).alias("stage"), F.min_by(value, place).alias("value"))


def outcomes(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Samples, and those without or with a negative end-to-end time."""
    return samples.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.count_if(F.col("outcome") == "unavailable").alias("unavailable"), F.count_if(F.col("outcome") == "negative").alias("negative")
    )


def latency_series(samples: DataFrame, keys: list[str], order: list[str], keep: int) -> DataFrame:
    """Summary of the last ``keep`` values of each key, measure (pipeline, e2e) and kind.

    ``samples`` has kind, pipeline and e2e; a null or negative end-to-end time enters no series.
    """
    long = samples.withColumn("m", F.explode(F.array(
        F.struct(F.lit("pipeline").alias("measure"), F.col("pipeline").alias("value")),
        F.struct(F.lit("e2e").alias("measure"), F.when(F.col("e2e") >= 0, F.col("e2e")).alias("value")),
    ))).select("*", "m.*").where("value is not null")
    by = [*keys, "measure", "kind"]
    return summary(ring(long, by, [F.col(c).desc() for c in order], keep), by, "value")


def metrics_snapshot(series: DataFrame, counters: DataFrame, key: str) -> DataFrame:
    """A row a process: its counters, and its latency series as a sorted array."""
    rows = series.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("measure", "kind", "n", "p50", "p95"))).alias("latency"))
    return counters.join(rows, key, "left")


def split_executions(jobs: DataFrame, label: str = "label") -> DataFrame:
    """Provider and whether a job is a diarization pass, which its label's suffix tells; no label is ``unknown``."""
    own = F.col(label).endswith(DIARIZATION)
    name = F.when(own, F.expr(f"substr({label}, 1, length({label}) - {len(DIARIZATION)})")).otherwise(F.col(label))
    return jobs.withColumn("diarization", F.coalesce(own, F.lit(False))).withColumn("provider", F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(name))


def executions(jobs: DataFrame) -> DataFrame:
    """Per provider and kind of job: timings, real-time factor where audio came in, failures. Times are nanoseconds."""
    ms, audio = F.lit(1e6), F.col("audio_seconds")
    factor = F.when(audio > 0, F.col("execution_ns") / 1e9 / audio)
    return split_executions(jobs).groupBy("provider", "diarization").agg(
        F.count("*").alias("runs"), F.avg(F.col("delay_ns") / ms).alias("delay_ms"), F.avg(F.col("execution_ns") / ms).alias("execution_ms"),
        F.max(F.col("execution_ns") / ms).alias("slowest_ms"), F.avg(factor).alias("real_time_factor"), F.count_if("failed").alias("failed"),
    )


def known_counters(deltas: DataFrame, known: list[str], keys: list[str]) -> DataFrame:
    """Totals of the known counters; names that nobody declared are left out."""
    return deltas.where(F.col("name").isin(known)).groupBy(*keys, "name").agg(F.sum("delta").alias("total"))


def capacity(windows: DataFrame, target: float, least: int, pinned: int | None = None) -> DataFrame:
    """Sessions each worker can bear.

    A pinned number wins. Too few clean samples give null, for nothing was measured; then target over
    the cost of a session holds, but not less than ``least``, which also stands in for a cost of zero.
    ``windows`` has worker, clean_samples and cost (busy share of one session).
    """
    ceiling = F.floor(F.lit(target) / F.when(F.col("cost") > 0, F.col("cost")))
    cap = F.when(F.col("clean_samples") >= CLEAN_SAMPLES, F.greatest(F.coalesce(ceiling, F.lit(least)), F.lit(least)))
    return windows.select("worker", (F.lit(pinned) if pinned is not None else cap).cast("long").alias("capacity"))


def admits(live: Column, cap: Column) -> Column:
    """An idle worker and one of unknown capacity take a session; others while one more fits."""
    return (live == 0) | cap.isNull() | (live + 1 <= cap)


def utilization(steps: DataFrame, keys: list[str], order: str, duration: float) -> DataFrame:
    """1 - idle over total of the last steps (idle, total) that together last ``duration`` or less, the newest in any case."""
    back = Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    recent = steps.withColumn("_after", F.coalesce(F.sum("total").over(back), F.lit(0.0))).where(F.col("_after") < duration)
    return recent.groupBy(*keys).agg((1 - F.try_divide(F.sum("idle"), F.sum("total"))).alias("utilization"))
