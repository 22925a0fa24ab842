"""Queries on single rules and formats: sessions, conflicts, days, sample effects, speech, turns as lines, alerts by readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import audio
from tidemark.operators import alerts, schedule
from tidemark.plans.register import Registry, table
from tidemark.plans.telemetry import now
from tidemark.sources import text_formats

registry = Registry()


@registry.query("""WITH o AS (SELECT o_custkey AS room_uid, o_orderkey AS uid, o_orderdate AS a, o_orderdate + to_days((1 + o_orderkey % 9)::INT) AS b FROM orders)
    SELECT x.room_uid, x.uid AS uid_a, y.uid AS uid_b FROM o x JOIN o y ON x.room_uid = y.room_uid AND x.uid < y.uid AND x.a < y.b AND y.a < x.b""")
def schedule_conflicts(spark, sf_dir):
    start = F.col("o_orderdate").cast("timestamp")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("room_uid"), F.col("o_orderkey").alias("uid"), start.alias("start_utc"), (start + F.make_dt_interval((1 + F.col("o_orderkey") % 9).cast("int"))).alias("end_utc"))
    return schedule.conflicts(o)


@registry.query("""WITH s AS (SELECT o_orderkey AS uid, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 1 DAY END, o_orderdate) AS a, CASE WHEN o_orderkey % 7 > 0 THEN coalesce(CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 2 DAY END, o_orderdate + INTERVAL 30 DAY) END AS b,
      CASE o_orderstatus WHEN 'F' THEN 'ON_DEMAND' ELSE 'SCHEDULED' END AS kind, o_orderkey % 6 = 0 AS gone, TIMESTAMP '1996-01-01' AS now FROM orders)
    SELECT uid, epoch(a)::BIGINT AS begins, epoch(b)::BIGINT AS ends, CASE WHEN now < a THEN 'UPCOMING' WHEN b IS NULL OR now < b THEN 'ACTIVE' ELSE 'ENDED' END AS state,
      CASE WHEN kind <> 'SCHEDULED' THEN 'NOT_SCHEDULED_TYPE' WHEN gone THEN 'ALREADY_CANCELED' WHEN a <= now THEN 'NOT_UPCOMING' ELSE 'OK' END AS cancel, CASE WHEN gone THEN 'OK' ELSE 'SESSION_NOT_CANCELED' END AS uncancel FROM s""")
def session_rows(spark, sf_dir):
    """Sessions as they are read: overrides first, open ends kept, their state, and whether they may be cancelled or brought back."""
    at, key = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey")
    plus = lambda n: at + F.make_dt_interval(F.lit(n))
    never = F.lit(None).cast("timestamp")
    s = table(spark, sf_dir, "orders").select(
        key.alias("uid"), at.alias("scheduled_start_time"), F.when(key % 4 == 0, plus(1)).otherwise(never).alias("start_override"), F.when(key % 7 > 0, plus(30)).alias("scheduled_end_time"),
        F.when((key % 5 == 0) & (key % 7 > 0), plus(2)).alias("end_override"), F.when(F.col("o_orderstatus") == "F", "ON_DEMAND").otherwise("SCHEDULED").alias("kind"), F.when(key % 6 == 0, at).alias("canceled_at"),
    )
    s = schedule.effective(s)
    then = F.lit("1996-01-01").cast("timestamp")
    a, b = F.col("effective_start"), F.col("effective_end")
    return s.select(
        "uid", F.unix_timestamp(a).alias("begins"), F.unix_timestamp(b).alias("ends"), schedule.state(a, b, then).alias("state"),
        schedule.cancel_verdict(F.col("kind"), F.col("canceled_at"), a, then).alias("cancel"), schedule.uncancel_verdict(F.col("canceled_at")).alias("uncancel"),
    )


@registry.query("""SELECT o_orderkey, list_sort(list_distinct([o_orderkey % 3, o_orderkey % 5, o_orderkey % 2])) = list_sort(list_distinct([o_custkey % 2, o_custkey % 5, o_custkey % 3])) AS same FROM orders""")
def same_days(spark, sf_dir):
    days = lambda c, *by: F.array(*(F.col(c) % n for n in by))
    return table(spark, sf_dir, "orders").select("o_orderkey", schedule.same_days(days("o_orderkey", 3, 5, 2), days("o_custkey", 2, 5, 3)).alias("same"))


@registry.query("""SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN 'node' || c_nationkey END AS node, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS segment FROM customer""")
def parsed_series_keys(spark, sf_dir):
    """Labels to a series' key and back; a series without labels has none."""
    c = table(spark, sf_dir, "customer")
    labels = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("node"), F.concat(F.lit("node"), F.col("c_nationkey").cast("string")))
    key = F.when(F.col("c_custkey") % 5 > 0, text_formats.series_key(labels)).otherwise("")
    back = text_formats.parsed_series_key(key)
    return c.select("c_custkey", F.try_element_at(back, F.lit("node")).alias("node"), F.try_element_at(back, F.lit("segment")).alias("segment"))


_PCM = "p AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(-32768, least(32767, round_even(x::DOUBLE * 60000, 0)::INTEGER))) AS s FROM embeddings)"
_CUT = lambda e: f"greatest(-32768, least(32767, round_even({e}, 0)::INTEGER))"


@registry.query(f"""WITH {_PCM}, l AS (SELECT *, list_reverse_sort(list_transform(s, lambda x: abs(x)))[greatest(1, floor(len(s) * 0.1)::INT)] AS loud FROM p)
    SELECT vec_id, round(20 * log10(sqrt(list_sum(list_transform(s, lambda x: x::DOUBLE * x)) / len(s)) / 32768), 6) AS level, list_transform(s, lambda x: {_CUT('x * 10 ** (6.0 / 20)')}) AS gained, list_transform(s, lambda x: {_CUT('(x + 500)::DOUBLE')}) AS shifted,
      CASE WHEN loud > 0 THEN list_transform(s, lambda x: {_CUT('x * (32767 / loud)')}) ELSE s END AS railed, len(s) = 0 OR list_max(list_transform(s, lambda x: abs(x))) <= 30000 AND sqrt(list_sum(list_transform(s, lambda x: x::DOUBLE * x)) / len(s)) <= 8000 AS silent FROM l""")
def sample_effects(spark, sf_dir):
    """Gain, offset and clipping of 16-bit samples, their level, and whether they are silent."""
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: audio.saturated(x.cast("double") * 60_000)).alias("s"))
    s = F.col("s")
    return p.select("vec_id", F.round(audio.rms_dbfs(s), 6).alias("level"), audio.gained(s, 6.0).alias("gained"), audio.shifted(s, 500).alias("shifted"), audio.hard_clipped(s, 0.1).alias("railed"), audio.silent(s, 30_000.0, 8_000.0).alias("silent"))


@registry.query("""WITH r AS (SELECT o_custkey AS k, count(*) AS n, sum(1.0 + o_orderkey % 4) AS speech FROM orders GROUP BY 1)
    SELECT k, round(speech / 60, 9) AS active_ratio, n AS segments, round(speech / n, 9) AS mean_seconds, CASE WHEN speech / 60 < 1 THEN round(speech / (60 - speech), 9) END AS speech_to_pause FROM r""")
def speech_shares(spark, sf_dir):
    """How much of a minute is speech, in how many ranges."""
    length = 1.0 + F.col("o_orderkey") % 4
    r = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list(F.struct(F.lit(0.0).alias("start"), length.alias("end"))).alias("r"))
    v = r.select("k", audio.vad_stats(F.col("r"), F.lit(60.0)).alias("v"))
    return v.select("k", F.col("v.segments").cast("long").alias("segments"), *(F.round(F.col(f"v.{c}"), 9).alias(c) for c in ("active_ratio", "mean_seconds", "speech_to_pause")))


@registry.query("""SELECT 'f' || o_custkey AS file, o_orderkey + 0.125::DOUBLE AS start, round(o_orderkey + 0.125 + 0.25 * (1 + o_orderkey % 9), 6)::DOUBLE AS "end", 's' || o_orderkey % 4 AS label FROM orders""")
def turns_from_lines(spark, sf_dir):
    """Turns as RTTM lines, among lines of other kinds, and read back."""
    o = table(spark, sf_dir, "orders")
    start = F.col("o_orderkey") + 0.125
    turns = o.select(F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("file"), start.alias("start"), (start + 0.25 * (1 + F.col("o_orderkey") % 9)).alias("end"), F.concat(F.lit("s"), (F.col("o_orderkey") % 4).cast("string")).alias("label"))
    other = o.select(F.concat(F.lit("SPKR-INFO f"), F.col("o_custkey").cast("string")).alias("value"))
    return text_formats.rttm_turns(text_formats.rttm_lines(turns).unionByName(other)).withColumn("end", F.round("end", 6))


@registry.query("""SELECT 'f' || c_custkey AS file, c_nationkey + 0.5::DOUBLE AS start, c_nationkey + 60.25::DOUBLE AS "end" FROM customer""")
def regions_from_lines(spark, sf_dir):
    """Scored regions as UEM lines, among blank ones, and read back."""
    c = table(spark, sf_dir, "customer")
    regions = c.select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("file"), (F.col("c_nationkey") + 0.5).alias("start"), (F.col("c_nationkey") + 60.25).alias("end"))
    return text_formats.uem_regions(text_formats.uem_lines(regions).unionByName(c.select(F.lit("  ").alias("value"))))


#: What an event counts as, by its number modulo the length of this list, and how much.
_READINGS = (
    ("auth_fail", "1.0"), ("auth_ok", "1.0"), ("close_auth_fail", "1.0"), ("close_ok", "1.0"), ("latency_negative", "4.0"), ("latency_samples", "9.0"), ("buffer_overflow", "value / 12"), ("jobs", "9.0"), ("rtf_sum", "value / 4"),
    ("status_up", "event_id % 2 + 0.0"), ("status_not_found", "user_id % 3 + 0.0"), ("worker_alive", "event_id % 4 + 0.0"), ("upstream_connected", "event_id % 5 + 0.0"), ("canary_ok", "event_id % 3 + 0.0"), ("canary_recall", "value / 40"),
    ("canary_latency_seconds", "value"), ("canary_repetition", "value / 30"), ("diarization_audio_seconds", "40.0"), ("diarization_uncovered_seconds", "value / 3"), ("diarization_lag_p95", "value"), ("diarization_stalled", "event_id % 7 + 0.0"),
)
_TOTAL = ", ".join(f"coalesce(sum(v) FILTER (m = {k}), 0) AS t_{n}, arg_max(v, ts) FILTER (m = {k}) AS l_{n}" for k, (n, _) in enumerate(_READINGS))
_VALUE = " ".join(f"WHEN {k} THEN {e}" for k, (_, e) in enumerate(_READINGS))


@registry.query(f"""WITH e AS (SELECT user_id::VARCHAR AS series, event_id % {len(_READINGS)} AS m, ts, (CASE event_id % {len(_READINGS)} {_VALUE} END)::DOUBLE AS v FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 25 DAY),
    t AS (SELECT series, {_TOTAL} FROM e GROUP BY series),
    x AS (SELECT *, CASE WHEN t_auth_fail + t_auth_ok > 0 THEN t_auth_fail ELSE t_close_auth_fail END AS failed, CASE WHEN t_auth_fail + t_auth_ok > 0 THEN t_auth_fail + t_auth_ok ELSE t_close_auth_fail + t_close_ok END AS tried, l_diarization_stalled IS NOT DISTINCT FROM 1 AS stalled FROM t),
    y AS (SELECT *, NOT stalled AND t_diarization_audio_seconds >= 60 AND t_diarization_uncovered_seconds / t_diarization_audio_seconds >= 0.1 AS slow FROM x),
    a AS (SELECT 'upstream-down' AS id, 'CRITICAL' AS severity, series, l_upstream_connected AS observed FROM y WHERE l_upstream_connected = 0
      UNION ALL SELECT 'transcription-falling-behind', 'WARNING', series, t_rtf_sum / t_jobs FROM y WHERE t_jobs >= 20 AND t_rtf_sum / t_jobs >= 0.45
      UNION ALL SELECT 'worker-dead', 'CRITICAL', series, l_worker_alive FROM y WHERE l_worker_alive = 0
      UNION ALL SELECT 'buffer-overflow', 'WARNING', series, t_buffer_overflow FROM y WHERE t_buffer_overflow >= 5
      UNION ALL SELECT 'auth-failure', 'WARNING', series, failed / tried FROM y WHERE tried >= 5 AND failed / tried >= 0.5
      UNION ALL SELECT CASE WHEN t_status_not_found > 0 THEN 'status-poll-refused' ELSE 'status-poll-unavailable' END, CASE WHEN t_status_not_found > 0 THEN 'CRITICAL' ELSE 'WARNING' END, series, l_status_up FROM y WHERE l_status_up <> 1
      UNION ALL SELECT 'clock-skew', 'WARNING', series, t_latency_negative / t_latency_samples FROM y WHERE t_latency_samples >= 20 AND t_latency_negative / t_latency_samples >= 0.2
      UNION ALL SELECT 'canary-failure', 'CRITICAL', series, l_canary_ok FROM y WHERE l_canary_ok = 0
      UNION ALL SELECT 'canary-latency', 'WARNING', series, l_canary_latency_seconds FROM y WHERE l_canary_latency_seconds > 15
      UNION ALL SELECT 'canary-recall', 'WARNING', series, l_canary_recall FROM y WHERE l_canary_recall < 0.5
      UNION ALL SELECT 'canary-repetition', 'WARNING', series, l_canary_repetition FROM y WHERE l_canary_repetition > 0.8
      UNION ALL SELECT 'diarization-stalled', 'WARNING', series, 1 FROM y WHERE stalled
      UNION ALL SELECT 'diarization-uncovered', 'WARNING', series, t_diarization_uncovered_seconds / t_diarization_audio_seconds FROM y WHERE slow
      UNION ALL SELECT 'diarization-lag', 'WARNING', series, l_diarization_lag_p95 FROM y WHERE NOT stalled AND NOT slow AND t_diarization_audio_seconds >= 60 AND l_diarization_lag_p95 >= 10)
    SELECT id, severity, series, round(observed, 6) AS observed FROM a""")
def alerts_by_readings(spark, sf_dir):
    """Events as readings of all kinds: what each user's series raises."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.col("event_id") % len(_READINGS)
    name, value = (F.coalesce(*(F.when(k == i, pick(r)) for i, r in enumerate(_READINGS))) for pick in (lambda r: F.lit(r[0]), lambda r: F.expr(r[1]).cast("double")))
    found = alerts.evaluate(e.select("ts", name.alias("metric"), F.col("user_id").cast("string").alias("series"), value.alias("value")), now(), "25 DAYS")
    return found.select("id", "severity", "series", F.round("observed", 6).alias("observed"))
