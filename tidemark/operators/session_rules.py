"""What may be done with a session, and what it and its audio look like, at an instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Audio thresholds (levels in dBFS, clipping as a fraction, noise ratio in dB), and the order of statuses.
CLIPPING, QUIET, HOT, NOISY = 0.01, -50.0, -6.0, 10.0
STATUSES = ("crit", "warn", "good", "idle")


def effective_start() -> Column:
    return F.coalesce("start_override", "scheduled_start")


def effective_end() -> Column:
    return F.coalesce("end_override", "scheduled_end")


def is_ended(now: Column) -> Column:
    """Cancelled, or at or past its end; an open one never ends."""
    return F.col("canceled_at").isNotNull() | F.coalesce(effective_end() <= now, F.lit(False))


def window_state(now: Column) -> Column:
    """before, within or after; the end itself is still within, and so is anything once an open session has begun."""
    return F.when(now < effective_start(), "before").when(now > effective_end(), "after").otherwise("within")


def can_cancel(now: Column) -> Column:
    return (F.col("type") == "SCHEDULED") & F.col("canceled_at").isNull() & (effective_start() > now)


def can_start_early(now: Column) -> Column:
    return (F.col("type") != "AUTO") & (effective_start() > now)


def can_end_early(now: Column) -> Column:
    return (F.col("type") != "AUTO") & (effective_start() <= now) & F.coalesce(effective_end() > now, F.lit(True))


def session_status(upstream: Column, source_up: Column, service_up: Column) -> Column:
    """Status by the upstream connection; the latest event, where there is one, tells first of a lost end."""
    return (
        F.when(~source_up | ~service_up, "crit").when(upstream == "OPEN", "good")
        .when(upstream.isin("WAITING_RETRY", "CONNECTING", "HANDSHAKING"), "warn").when(upstream == "CLOSED", "crit").otherwise("idle")
    )


def audio_status(present: Column, upstream: Column, metered: Column, silent: Column, clipping: Column, level: Column, vad: Column, snr: Column) -> Column:
    """Status of a session's audio. Missing audio is critical on an open connection only; audio without levels is unknown."""
    weak = (level < QUIET) | (level > HOT) | (vad & (snr < NOISY))
    return (
        F.when(~present, F.when(upstream == "OPEN", "crit").otherwise("unknown")).when(~metered, "unknown")
        .when(silent, "crit").when(clipping > CLIPPING, "crit").when(weak, "warn").otherwise("good")
    )


def pipeline_p95(latency: str = "latency") -> Column:
    """p95 of the final pipeline series in an array of (measure, kind, count, p95); null where it has no samples."""
    hit = F.filter(latency, lambda s: (s["measure"] == "pipeline") & (s["kind"] == "final"))
    first = F.try_element_at(hit, F.lit(1))
    return F.when(first["count"] > 0, first["p95"])


def filtered(
    sessions: DataFrame, statuses: list[str] | None = None, provider: str | None = None, audio: list[str] | None = None, text: str | None = None
) -> DataFrame:
    """Fleet rows (session_uid, room_uid, provider, status, audio_status, p95) that meet every filter given, worst status and slowest first."""
    out = sessions
    if statuses:
        out = out.where(F.col("status").isin(statuses))
    if provider:
        out = out.where(F.col("provider") == provider)
    if audio:
        out = out.where(F.col("audio_status").isin(audio))
    if text and (t := text.strip().lower()):
        out = out.where(F.lower("session_uid").contains(t) | F.coalesce(F.lower("room_uid").contains(t), F.lit(False)))
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    return out.orderBy(rank, F.coalesce("p95", F.lit(0.0)).desc(), "session_uid")


def latest_audio(audio: DataFrame, session: str, order: list[str]) -> DataFrame:
    """The last snapshot of each session, as one struct column ``audio``."""
    rest = [c for c in audio.columns if c != session]
    return audio.groupBy(session).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("audio"))
