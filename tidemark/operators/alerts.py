"""Alert rules: functions from a metrics frame to alert rows, joined by union.

The metrics frame has (ts, metric, series, value): increments of counters and readings of gauges.
Every rule counts in one aggregate over the window, so all rules share one scan and one shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds and severity ranks.
RATE_WINDOW = "120 SECONDS"
CHURN = 3
DECODE_DROPS = 10
OVERFLOWS = 5
EVICTIONS = 10
RTF_P95 = 2.0
RTF_P99, RTF_P99_JOBS = 3.0, 100
DUTY, DUTY_CPU, DUTY_JOBS = 0.45, 0.7, 20
DROP_RATIO, DROP_CRITICAL, DROP_PERIODS = 0.25, 0.5, 20
AUTH_RATIO, AUTH_SAMPLES = 0.5, 5
SKEW_RATIO, SKEW_SAMPLES = 0.2, 20
PROBE_FAILURES = 2
CANARY_SECONDS, CANARY_RECALL, CANARY_REPETITION = 15.0, 0.5, 0.8
UNCOVERED, LAG_P95, COVERED_SECONDS = 0.1, 10.0, 60.0
SEVERITY = {"CRITICAL": 3, "WARNING": 2, "INFO": 1}

ALERT = ["id", "severity", "series", "observed"]


def window_totals(metrics: DataFrame, now: Column, window: str = RATE_WINDOW) -> DataFrame:
    """One row a series: what each metric adds up to in the window, and its last reading."""
    inside = metrics.where(F.col("ts") >= now - F.expr(f"INTERVAL {window}"))
    cells = inside.groupBy("series", "metric").agg(F.sum("value").alias("total"), F.max_by("value", "ts").alias("last"))
    pairs = F.collect_list(F.struct("metric", "total"))
    lasts = F.collect_list(F.struct("metric", "last"))
    return cells.groupBy("series").agg(F.map_from_entries(pairs).alias("total"), F.map_from_entries(lasts).alias("last"))


def _got(side: str, metric: str) -> Column:
    return F.coalesce(F.try_element_at(F.col(side), F.lit(metric)), F.lit(0.0))


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    when: Column
    observed: Column


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def rules() -> list[Rule]:
    churn, decode, overflow, evicted = (_got("total", m) for m in ("upstream_retry", "decode_drop", "buffer_overflow", "chunk_eviction"))
    dropped = _got("total", "dropped_audio_seconds")
    passes, drops = _got("total", "periods_run"), _got("total", "periods_dropped")
    scheduled = passes + drops
    jobs, busy = _got("total", "jobs"), _got("total", "rtf_sum")
    fail, ok = _got("total", "auth_fail"), _got("total", "auth_ok")
    closed = _got("total", "close_auth_fail")
    failed = F.when(fail + ok > 0, fail).otherwise(closed)
    tried = F.when(fail + ok > 0, fail + ok).otherwise(closed + _got("total", "close_ok"))
    negative, samples = _got("total", "latency_negative"), _got("total", "latency_samples")
    audio, uncovered = _got("total", "diarization_audio_seconds"), _got("total", "diarization_uncovered_seconds")
    share = _ratio(drops, scheduled)
    mean = _ratio(busy, jobs)
    duty = F.when(_got("last", "device_cpu") == 1, DUTY_CPU).otherwise(DUTY)
    critical = (scheduled >= DROP_PERIODS) & (share >= DROP_CRITICAL) | (scheduled < DROP_PERIODS) & (_got("last", "rtf_p95") >= RTF_P95)
    behind = (jobs >= DUTY_JOBS) & (mean >= duty)
    tail = ((scheduled >= DROP_PERIODS) & (share >= DROP_RATIO) | (jobs >= RTF_P99_JOBS) & (_got("last", "rtf_p99") >= RTF_P99)) & ~critical & ~F.coalesce(behind, F.lit(False))
    up = F.try_element_at(F.col("last"), F.lit("status_up"))
    denied = _got("total", "status_unauthorized") + _got("total", "status_not_found") > 0
    alive = F.try_element_at(F.col("last"), F.lit("worker_alive"))
    upstream = F.try_element_at(F.col("last"), F.lit("upstream_connected"))
    canary = F.try_element_at(F.col("last"), F.lit("canary_ok"))
    late, recall, repeat = (F.try_element_at(F.col("last"), F.lit(m)) for m in ("canary_latency_seconds", "canary_recall", "canary_repetition"))
    stalled = _got("last", "diarization_stalled") == 1
    slow = ~stalled & (audio >= COVERED_SECONDS) & (_ratio(uncovered, audio) >= UNCOVERED)
    lag = ~stalled & ~F.coalesce(slow, F.lit(False)) & (audio >= COVERED_SECONDS) & (_got("last", "diarization_lag_p95") >= LAG_P95)
    return [
        Rule("upstream-churn", "WARNING", churn >= CHURN, churn),
        Rule("upstream-down", "CRITICAL", upstream == 0, upstream),
        Rule("transcription-saturation", "CRITICAL", critical, F.coalesce(share, _got("last", "rtf_p95"))),
        Rule("transcription-falling-behind", "WARNING", behind, mean),
        Rule("transcription-tail-overrun", "WARNING", tail, F.coalesce(share, _got("last", "rtf_p99"))),
        Rule("worker-dead", "CRITICAL", alive == 0, alive),
        Rule("buffer-overflow", "WARNING", overflow >= OVERFLOWS, overflow),
        Rule("audio-dropped", "WARNING", dropped > 0, dropped),
        Rule("decode-drop", "WARNING", decode >= DECODE_DROPS, decode),
        Rule("auth-failure", "WARNING", (tried >= AUTH_SAMPLES) & (_ratio(failed, tried) >= AUTH_RATIO), _ratio(failed, tried)),
        Rule("status-poll-refused", "CRITICAL", (up != 1) & denied, up),
        Rule("status-poll-unavailable", "WARNING", (up != 1) & ~denied, up),
        Rule("clock-skew", "WARNING", (samples >= SKEW_SAMPLES) & (_ratio(negative, samples) >= SKEW_RATIO), _ratio(negative, samples)),
        Rule("pending-chunk-eviction", "WARNING", evicted >= EVICTIONS, evicted),
        Rule("canary-failure", "CRITICAL", canary == 0, canary),
        Rule("canary-latency", "WARNING", late > CANARY_SECONDS, late),
        Rule("canary-recall", "WARNING", recall < CANARY_RECALL, recall),
        Rule("canary-repetition", "WARNING", repeat > CANARY_REPETITION, repeat),
        Rule("diarization-stalled", "WARNING", stalled, F.lit(1.0)),
        Rule("diarization-uncovered", "WARNING", slow, _ratio(uncovered, audio)),
        Rule("diarization-lag", "WARNING", lag, _got("last", "diarization_lag_p95")),
    ]


def evaluate(metrics: DataFrame, now: Column, window: str = RATE_WINDOW, chosen: list[Rule] | None = None) -> DataFrame:
    """Alerts of all rules, severest first, then by id and series.

    The rules are one array of structs over one row a series, so the totals are computed once.
    """
    totals = window_totals(metrics, now, window)
    said = [
        F.when(r.when, F.struct(F.lit(r.id).alias("id"), F.lit(r.severity).alias("severity"), r.observed.cast("double").alias("observed")))
        for r in (rules() if chosen is None else chosen)
    ]
    rows = totals.select("series", F.explode(F.array_compact(F.array(*said))).alias("a")).select("a.id", "a.severity", "series", "a.observed")
    rank = F.create_map(*(x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))))[F.col("severity")]
    return rows.withColumn("rank", rank).orderBy(F.col("rank").desc(), "id", "series")


def probe_down(probes: DataFrame, least: int = PROBE_FAILURES) -> DataFrame:
    """Probes (target, ts, healthy) whose latest ``least`` or more results all failed."""
    from tidemark.operators.metrics import consecutive

    return consecutive(probes, ["target"], ["ts"], ~F.col("healthy"), least)

