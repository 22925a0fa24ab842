"""Console settings from parts, and small values on suppliers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import captions, config, jobs, lookups, materialise, presence, rolling, tables, values
from tidemark.plans.lookups import members
from tidemark.plans.register import Registry, table

registry = Registry()

_C = """c AS (SELECT p_partkey AS k, ['development', 'staging', 'production'][p_partkey % 3 + 1] AS env, p_size % 7 = 0 AS dev, ['', 'changeme-key', 'own-api-key'][p_size % 3 + 1] AS api,
    ['', 'CHANGEME', 'short', 'a-session-secret-of-thirty-three-x'][p_size % 4 + 1] AS secret, ['', 'xCHANGEMEx', 'own'][p_partkey % 3 + 1] AS db, 'own' AS audio,
    ['', 'admin changeme', 'admin', 'admin short', 'admin a-long-password'][p_size % 5 + 1] AS local, CASE WHEN p_partkey % 4 > 0 THEN 'x' ELSE '' END AS sso, CASE WHEN p_partkey % 8 > 1 THEN 'x' ELSE '' END AS uri,
    CASE WHEN p_partkey % 5 > 1 THEN 'x' ELSE '' END AS grp, ['', 'redis://redis:6379', 'redis://:changeme@redis:6379', 'redis://u:own@redis:6379', 'nonsense'][p_size % 5 + 1] AS redis FROM part),
  d AS (SELECT *, trim(local) <> '' AS is_local, upper(local) LIKE '%CHANGEME%' AS example, 3 * (sso <> '')::INTEGER + (uri <> '')::INTEGER + (grp <> '')::INTEGER AS n FROM c),
  r AS (SELECT k, env, id, CASE env WHEN 'development' THEN s[1] WHEN 'staging' THEN s[2] ELSE s[3] END AS severity FROM (
    SELECT k, env, 'dev-flag-in-deployed-env' AS id, ['ok', 'critical', 'critical'] AS s FROM d WHERE dev
    UNION ALL SELECT k, env, 'admin-api-key-placeholder', ['advisory', 'critical', 'critical'] FROM d WHERE upper(api) LIKE '%CHANGEME%'
    UNION ALL SELECT k, env, 'admin-session-secret-placeholder', ['advisory', 'critical', 'critical'] FROM d WHERE secret = 'CHANGEME'
    UNION ALL SELECT k, env, 'db-password-placeholder', ['advisory', 'critical', 'critical'] FROM d WHERE db = 'xCHANGEMEx'
    UNION ALL SELECT k, env, 'admin-api-key-missing', ['critical', 'critical', 'critical'] FROM d WHERE api = ''
    UNION ALL SELECT k, env, 'db-password-missing', ['warning', 'critical', 'critical'] FROM d WHERE db = ''
    UNION ALL SELECT k, env, 'admin-session-secret-missing', ['advisory', 'warning', 'critical'] FROM d WHERE secret = ''
    UNION ALL SELECT k, env, 'admin-session-secret-weak', ['advisory', 'warning', 'critical'] FROM d WHERE secret = 'short'
    UNION ALL SELECT k, env, 'sso-incomplete-config', ['advisory', 'warning', 'warning'] FROM d WHERE n BETWEEN 1 AND 4 AND (sso = '' OR uri = '')
    UNION ALL SELECT k, env, 'admin-local-credentials-placeholder', ['advisory', 'critical', 'critical'] FROM d WHERE is_local AND example
    UNION ALL SELECT k, env, 'admin-local-credentials-malformed', ['advisory', 'critical', 'critical'] FROM d WHERE local = 'admin'
    UNION ALL SELECT k, env, 'admin-local-credentials-weak', ['advisory', 'warning', 'critical'] FROM d WHERE local = 'admin short'
    UNION ALL SELECT k, env, 'no-login-method', ['critical', 'critical', 'critical'] FROM d WHERE NOT is_local AND n < 5
    UNION ALL SELECT k, env, 'local-login-only', ['ok', 'advisory', 'warning'] FROM d WHERE is_local AND sso = ''
    UNION ALL SELECT k, env, 'sso-no-group-restriction', ['advisory', 'warning', 'critical'] FROM d WHERE sso <> '' AND grp = ''
    UNION ALL SELECT k, env, 'fleet-telemetry-disabled', ['advisory', 'advisory', 'warning'] FROM d WHERE redis = ''
    UNION ALL SELECT k, env, 'redis-url-no-password', ['advisory', 'warning', 'critical'] FROM d WHERE redis = 'redis://redis:6379'
    UNION ALL SELECT k, env, 'redis-url-placeholder-password', ['advisory', 'critical', 'critical'] FROM d WHERE redis LIKE '%changeme%'))"""


@registry.query(f"WITH {_C} SELECT k, id, severity FROM r WHERE severity <> 'ok'")
def console_findings(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda by, *v: F.element_at(F.array(*map(F.lit, v)), (by % len(v) + 1).cast("int"))
    sso = F.when(key % 4 > 0, "x").otherwise("")
    s = table(spark, sf_dir, "part").select(
        key.alias("k"), pick(key, *config.ENVIRONMENTS).alias("declared_env"), (size % 7 == 0).alias("is_development"), pick(size, "", "changeme-key", "own-api-key").alias("admin_api_key"),
        pick(size, "", "CHANGEME", "short", "a-session-secret-of-thirty-three-x").alias("admin_session_secret"), pick(key, "", "xCHANGEMEx", "own").alias("db_password"), F.lit("own").alias("test_audio_service_key"),
        pick(size, "", "admin changeme", "admin", "admin short", "admin a-long-password").alias("local_credentials"), sso.alias("azure_tenant_id"), sso.alias("azure_client_id"), sso.alias("azure_client_secret"),
        F.when(key % 8 > 1, "x").otherwise("").alias("azure_redirect_uri"), F.when(key % 5 > 1, "x").otherwise("").alias("allowed_group"),
        pick(size, "", "redis://redis:6379", "redis://:changeme@redis:6379", "redis://u:own@redis:6379", "nonsense").alias("redis_url"),
    )
    return config.findings(s, config.console_checks(), ["k"]).select("k", "id", "severity")


@registry.query("SELECT o_orderkey, o_orderdate + INTERVAL 168 HOUR AS week_on, greatest(o_orderdate, TIMESTAMP '1998-01-01') AS later, o_orderdate + INTERVAL 1 DAY > TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-02-01' AS admitted FROM orders")
def date_steps(spark, sf_dir):
    at, lo, hi = F.col("o_orderdate").cast("timestamp_ntz"), F.lit("1998-01-01").cast("timestamp_ntz"), F.lit("1998-02-01").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", materialise.add_days(at, 7).alias("week_on"), materialise.later(at, lo).alias("later"), materialise.admitted(at, materialise.add_days(at, 1), lo, hi).alias("admitted")
    )


@registry.query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders")
def sorted_slots(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("start"), F.col("o_orderdate").alias("end"))
    return materialise.by_start(o, ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))


@registry.query("SELECT event_id, round(value * 10 - 200, 6) AS rtt, CASE WHEN value >= 20 THEN round(value * -3, 6) END AS \"offset\", CASE WHEN value >= 20 THEN round(1000 - value * 3, 6) END AS remote FROM events")
def clock_probes(spark, sf_dir):
    v = F.col("value")
    e = table(spark, sf_dir, "events").select("event_id", v)
    out = values.probe_rows(e, "event_id", v)
    return out.select("event_id", *(F.round(c, 6).alias(c) for c in ("rtt", "offset", "remote")))


@registry.query("SELECT s_suppkey, (CASE s_suppkey % 3 WHEN 0 THEN 0.7 ELSE 0.45 END)::DOUBLE AS threshold, round(0.2126 * r + 0.7152 * g + 0.0722 * b, 6) AS luminance FROM (SELECT *, pow((128 / 255.0::DOUBLE + 0.055) / 1.055, 2.4) AS r, 10 / 255.0::DOUBLE / 12.92 AS g, CASE WHEN s_nationkey / 255.0::DOUBLE <= 0.04045 THEN s_nationkey / 255.0::DOUBLE / 12.92 ELSE pow((s_nationkey / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END AS b FROM supplier)")
def small_values(spark, sf_dir):
    device = F.when(F.col("s_suppkey") % 3 == 0, "cpu").when(F.col("s_suppkey") % 3 == 1, "cuda")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", values.unknown_threshold(device).alias("threshold"), F.round(values.luminance(F.lit(128), F.lit(10), F.col("s_nationkey")), 6).alias("luminance")
    )


@registry.query("SELECT user_id, bool_or(CASE event_type WHEN 'view' THEN true WHEN 'click' THEN false END) AS active FROM events GROUP BY 1")
def microphone_states(spark, sf_dir):
    said = F.when(F.col("event_type") == "view", True).when(F.col("event_type") == "click", False)
    return captions.microphone(table(spark, sf_dir, "events").withColumn("said", said), ["user_id"], "said")


@registry.query("""SELECT user_id, event_id, segment FROM (SELECT user_id, event_id, event_type, sum((event_type = 'signup')::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS segment FROM events) WHERE event_type <> 'signup'""")
def config_segments(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return captions.config_segments(e, ["user_id"], "event_id", F.col("event_type") == "signup").select("user_id", "event_id", "segment")


@registry.query("""SELECT c_custkey AS session, k * 5.0::DOUBLE AS at, greatest(0.0, k * 5.0::DOUBLE - 10) AS "begin" FROM customer, generate_series(1, 30) g(k) WHERE k * 5 <= c_custkey % 97""")
def diarization_passes(spark, sf_dir):
    return captions.pass_plan(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session"), (F.col("c_custkey") % 97).alias("seconds")), 10.0, 5.0)


@registry.query("""WITH f AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN event_id + 400 END AS answered, lead(event_id, 3) OVER (PARTITION BY user_id ORDER BY event_id) AS pushed FROM events)
    SELECT user_id, event_id FROM f WHERE pushed IS NOT NULL AND (answered IS NULL OR answered > pushed)""")
def evicted_frames(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("answered", F.when(F.col("event_type") != "error", F.col("event_id") + 400))
    return captions.evicted(e, ["user_id"], "event_id", 3).select("user_id", "event_id")


#: The first touch, then each first one an hour or more after the one written before.
_WRITES = """WITH RECURSIVE e AS (SELECT DISTINCT user_id, epoch_us(ts) AS t FROM events{where}), n AS (SELECT e.user_id, e.t, min(f.t) AS next FROM e LEFT JOIN e f ON e.user_id = f.user_id AND f.t >= e.t + 3600000000 GROUP BY 1, 2),
    w AS (SELECT user_id, min(t) AS t FROM e GROUP BY 1 UNION ALL SELECT w.user_id, n.next FROM w JOIN n ON n.user_id = w.user_id AND n.t = w.t WHERE n.next IS NOT NULL)"""


def _touches(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)


@registry.query(_WRITES.replace("{where}", "") + " SELECT user_id, t AS last_seen FROM w")
def coalesced_touches(spark, sf_dir):
    """Touches that are written: an hour or more after the last one that was."""
    got = presence.coalesced(_touches(spark, sf_dir), "user_id", "at", 3600.0)
    return got.select("user_id", F.round(F.col("last_seen") * 1_000_000).cast("long").alias("last_seen"))


@registry.query(_WRITES.replace("{where}", " WHERE event_type <> 'signup'") + """ SELECT w.user_id, w.t AS published, min(event_id) AS event_id, count(*) AS readings FROM w JOIN events x ON x.user_id = w.user_id AND epoch_us(x.ts) = w.t AND event_type <> 'signup' GROUP BY 1, 2""")
def throttled_readings(spark, sf_dir):
    """Readings that are published: those of a session that come an hour or more after its last one."""
    e = _touches(spark, sf_dir).where("event_type <> 'signup'")
    got = presence.coalesced(e, "user_id", "at", 3600.0).withColumnRenamed("last_seen", "at")
    rows = got.join(e.select("user_id", "at", "event_id"), ["user_id", "at"]).groupBy("user_id", "at").agg(F.min("event_id").alias("event_id"), F.count("*").alias("readings"))
    return rows.select("user_id", F.round(F.col("at") * 1_000_000).cast("long").alias("published"), "event_id", "readings")


_E = "e AS (SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN 'f' || event_id END AS final, CASE WHEN event_type IN ('error', 'click') THEN 'p' || event_id END AS ip, event_type = 'signup' AS brk FROM events)"


@registry.query(f"""WITH {_E}, b AS (SELECT *, sum(brk::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM e) SELECT user_id, event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY g) - 1 AS paragraph, final FROM b WHERE final IS NOT NULL""")
def finalized_log(spark, sf_dir):
    return captions.handled(_transcripts(spark, sf_dir), ["user_id"], "event_id")[0]


@registry.query(f"""WITH {_E}, l AS (SELECT user_id, max(event_id) FILTER (ip IS NOT NULL) AS p, max(event_id) FILTER (final IS NOT NULL) AS f FROM e GROUP BY 1) SELECT user_id, CASE WHEN f IS NULL OR p >= f THEN 'p' || p END AS in_progress FROM l""")
def in_progress_texts(spark, sf_dir):
    return captions.handled(_transcripts(spark, sf_dir), ["user_id"], "event_id")[1]


def _transcripts(spark, sf_dir):
    kind, name = F.col("event_type"), F.col("event_id").cast("string")
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.when(kind == "view", F.concat(F.lit("f"), name)).alias("final"), F.when(kind.isin("error", "click"), F.concat(F.lit("p"), name)).alias("in_progress"),
        (kind == "signup").alias("is_break"),
    )


@registry.query("SELECT s_suppkey AS job, CASE WHEN s_acctbal > 0 THEN s_acctbal + 500 ELSE 5000.0 END + 500 AS deadline FROM supplier WHERE s_suppkey % 4 > 0 AND (s_acctbal <= 0 OR s_acctbal + 500 <= 5000)")
def ready_jobs(spark, sf_dir):
    j = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("job"), (F.col("s_suppkey") % 4).alias("queued"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("last_run"), F.lit(500.0).alias("period"))
    return captions.ready_jobs(j, F.lit(5000.0)).select("job", "deadline")


_UUID = "substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-8' || substr(d, 14, 3) || '-a' || substr(d, 18, 3) || '-' || substr(d, 21, 12)"


@registry.query(f"SELECT {_UUID} AS uid, room, name, TIMESTAMP '2024-01-01' AS created_at FROM (SELECT c_custkey AS room, c_name AS name, sha256(concat_ws(chr(31), 'room', c_custkey, c_name)) AS d FROM customer)")
def inserted_rows(spark, sf_dir):
    """Rooms as new rows: the key of each is a digest of its content, so an insert that runs again gives the same rows."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("room"), F.col("c_name").alias("name"))
    return tables.inserted(rows, "uid", "room", {"created_at": F.lit("2024-01-01").cast("timestamp_ntz")})


@registry.query(f"SELECT {_UUID} AS uid, order_key, window_start, NULL::VARCHAR AS canceled_by FROM (SELECT o_orderkey AS order_key, strftime(o_orderdate, '%Y-%m-%d') AS window_start, sha256(concat_ws(chr(31), 'session', o_orderkey, coalesce(CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END, chr(0)))) AS d, o_orderkey % 5 > 0 AS known FROM orders) WHERE known UNION ALL SELECT {_UUID}, order_key, NULL, NULL FROM (SELECT o_orderkey AS order_key, sha256(concat_ws(chr(31), 'session', o_orderkey, chr(0))) AS d FROM orders WHERE o_orderkey % 5 = 0)")
def inserted_sessions(spark, sf_dir):
    """Sessions as new rows, some without a start; a null is content of its own."""
    start = F.when(F.col("o_orderkey") % 5 > 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), start.alias("window_start"))
    return tables.inserted(rows, "uid", "session", {"canceled_by": F.lit(None).cast("string")})


@registry.query("""SELECT n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS params_summary FROM nation""")
def audit_rows(spark, sf_dir):
    return tables.audited(table(spark, sf_dir, "nation"), ["n_name", "n_regionkey"])


@registry.query("SELECT s_suppkey AS device_uid, s_suppkey AS room_uid, s_suppkey % 4 = 0 AND s_suppkey <> 8 AS is_source FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT -1, 8, true")
def member_added(spark, sf_dir):
    return tables.add_member(members(spark, sf_dir), "room_uid", "device_uid", "is_source", F.lit(8).cast("long"), F.lit(-1).cast("long"), True)


@registry.query("SELECT c_custkey AS uid, c_nationkey + (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'))::INTEGER AS version, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 1 ELSE 0 END AS touched FROM customer")
def finalized_rooms(spark, sf_dir):
    rooms = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_nationkey").alias("version"), F.lit(0).alias("touched"))
    keys = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("uid"))
    return tables.bumped(rooms, keys, "uid", "version", "touched", F.lit(1))


@registry.query(r"""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations WHERE text IS NOT NULL),
    h AS (SELECT *, ceil(length(t) / 2)::INT AS half, substr(t, 1, ceil(length(t) / 2)::INT) AS head FROM t),
    c AS (SELECT *, coalesce(nullif(length(regexp_extract(head, '(?s)^(.+\n\n)', 1)), 0), nullif(length(regexp_extract(head, '(?s)^(.*[.!?]["'')\]]*\s)', 1)), 0), nullif(length(regexp_extract(head, '(?s)^(.+\s)', 1)), 0), half) AS cut FROM h),
    b AS (SELECT conv_id, turn, length(t) AS n, regexp_replace(substr(t, 1, cut), '^\s+|\s+$', '', 'g') AS a, regexp_replace(substr(t, cut + 1), '^\s+|\s+$', '', 'g') AS b FROM c)
    SELECT conv_id, turn, CASE WHEN n >= 2 AND a <> '' AND b <> '' THEN a END AS first, CASE WHEN n >= 2 AND a <> '' AND b <> '' THEN b END AS second FROM b""")
def halved_texts(spark, sf_dir):
    """Both halves of each text, null where it cannot be cut."""
    h = values.bisected(F.col("text"))
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", h[0].alias("first"), h[1].alias("second"))


@registry.query("""WITH e AS (SELECT s_nationkey AS worker, s_suppkey AS job, CASE s_suppkey % 3 WHEN 0 THEN 'READY' WHEN 1 THEN 'SLEEPING' ELSE 'RUNNING' END AS state, s_acctbal AS t, 100.0 * (1 + s_suppkey % 7) AS period FROM supplier),
    r AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY t + period, job) AS k FROM e WHERE state = 'READY' AND t > 9000 OR state = 'SLEEPING' AND t < -500 OR state = 'READY' AND worker % 2 = 0)
    SELECT w.worker, r.job, r.t + r.period AS deadline, CASE WHEN r.job IS NULL THEN (SELECT min(t) FROM e WHERE e.worker = w.worker AND state = 'SLEEPING') + 500 END AS idle FROM (SELECT DISTINCT worker FROM e) w LEFT JOIN r ON r.worker = w.worker AND k = 1""")
def next_jobs(spark, sf_dir):
    """The job that each worker runs next, or how long it idles."""
    start, worker = F.col("s_acctbal"), F.col("s_nationkey")
    state = F.when(F.col("s_suppkey") % 3 == 0, F.when((start > 9000) | (worker % 2 == 0), "READY").otherwise("RUNNING")).when(F.col("s_suppkey") % 3 == 1, "SLEEPING").otherwise("RUNNING")
    e = table(spark, sf_dir, "supplier").select(worker.alias("worker"), F.col("s_suppkey").alias("job"), state.alias("state"), start.alias("period_start"), (100.0 * (1 + F.col("s_suppkey") % 7)).alias("period"))
    return jobs.next_jobs(e, F.lit(-500.0))


@registry.query("SELECT vec_id, round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS peak, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)) <= 0.125 AS silent FROM embeddings")
def meter_snapshots(spark, sf_dir):
    m = table(spark, sf_dir, "embeddings").select("vec_id", values.meter(F.col("embedding"), 0.125).alias("m"))
    return m.select("vec_id", F.round("m.peak", 6).alias("peak"), "m.silent")


@registry.query("SELECT o_orderkey, o_orderstatus AS code FROM orders WHERE o_orderdate > TIMESTAMP '1999-01-01' AND o_custkey = 7 ORDER BY o_orderdate")
def upcoming_in_room(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey"), F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("room_uid"), F.col("o_orderdate").cast("timestamp_ntz").alias("effective_start"), F.lit("AUTO").alias("type"), F.col("o_orderstatus").alias("code"))
    return lookups.upcoming(o.where("room_uid = 7"), ["AUTO"], F.lit("1999-01-01").cast("timestamp_ntz")).select("o_orderkey", "code")


@registry.query("""SELECT c_custkey, c_mktsegment AS lang, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 7 ELSE c_nationkey END::BIGINT AS size, c_acctbal > 0 AS dark, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS extra FROM customer""")
def deep_settings(spark, sf_dir):
    from tidemark.sources.text_formats import deep_merged

    base = F.struct(F.col("c_mktsegment").alias("lang"), F.struct(F.col("c_nationkey").cast("long").alias("size"), (F.col("c_acctbal") > 0).alias("dark")).alias("theme"))
    over = F.struct(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("extra"), F.struct(F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 7).alias("size")).alias("theme"))
    c = table(spark, sf_dir, "customer").select("c_custkey", base.alias("base"), over.alias("over"))
    m = c.select("c_custkey", deep_merged(F.col("base"), F.col("over"), c.schema["base"].dataType, c.schema["over"].dataType).alias("m"))
    return m.select("c_custkey", "m.lang", "m.theme.size", "m.theme.dark", "m.extra")


@registry.query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '{"room":' || s_suppkey || '}' END AS config FROM supplier""")
def config_fragments(spark, sf_dir):
    from tidemark.sources.text_formats import config_fragment

    text = F.concat(F.lit('{"room":'), F.col("s_suppkey").cast("string"), F.lit("}"))
    name = F.when(F.col("s_suppkey") % 2 == 0, "config=").otherwise("other=")
    url = F.concat(F.lit("https://x.example/a?b=1#"), name, F.base64(F.encode(text, "utf-8")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", config_fragment(url).alias("config"))


@registry.query("""SELECT '{"at":0,"counters":[' || (SELECT string_agg('{"name":"' || t || '","n":' || n || '}', ',' ORDER BY t) FROM (SELECT event_type AS t, count(*) AS n FROM events GROUP BY 1)) || '],"probes":[' ||
    (SELECT string_agg('{"service":"' || r_name || '","ok":' || (r_regionkey > 0) || '}', ',' ORDER BY r_name) FROM region) || '],"alerts":[],"canary":{"at":' || (SELECT max(event_id) FROM events) || ',"ok":true}}' AS json""")
def metrics_snapshot_json(spark, sf_dir):
    from tidemark.sources.text_formats import built_snapshot

    e = table(spark, sf_dir, "events")
    counters = e.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    probes = table(spark, sf_dir, "region").select(F.col("r_name").alias("service"), (F.col("r_regionkey") > 0).alias("ok"))
    alerts = probes.where("service is null").select(F.col("service").alias("id"))
    return built_snapshot(counters, probes, alerts, e.select(F.col("event_id").alias("at"), F.lit(True).alias("ok")), F.lit(0))


#: Samples of a label's vectors, one after the other, eight times as loud.
_SAMPLES = """v AS (SELECT label, vec_id, unnest(embedding)::DOUBLE * 8 AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT label, x, row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS pos, count(*) OVER (PARTITION BY label) AS total FROM v)"""


def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double") * 8).alias("samples"))


@registry.query(f"""WITH {_SAMPLES},
    b AS (SELECT label, pos // 100 AS block, count(*) AS n, greatest(-120, 10 * log10(sum(x * x) / count(*))) AS db FROM s GROUP BY ALL),
    w AS (SELECT b.label, b.block, s.pos, s.x FROM b JOIN s ON s.label = b.label AND s.pos // 100 BETWEEN b.block - 9 AND b.block WHERE b.n = 100 OR b.block < 10),
    r AS (SELECT label, block, count(*) AS run FROM (SELECT label, block, pos - row_number() OVER (PARTITION BY label, block ORDER BY pos) AS g FROM w WHERE abs(x) >= 0.99) GROUP BY label, block, g),
    c AS (SELECT label, block, sum(run) FILTER (run >= 2) AS charged FROM r GROUP BY ALL),
    m AS (SELECT label, block, count(*) AS n, greatest(-120, 10 * log10(sum(x * x) / count(*))) AS db, max(abs(x)) AS peak FROM w GROUP BY ALL),
    f AS (SELECT m.label, m.block, count(*) AS k, quantile_cont(b.db, 0.1) AS floor FROM m JOIN b ON b.label = m.label AND b.block BETWEEN m.block - 9 AND m.block AND b.n = 100 GROUP BY ALL)
    SELECT m.label, m.block, m.n, round(m.db, 6) AS rms_db, round(20 * log10(peak), 6) AS peak_db, round(coalesce(charged, 0) / m.n, 9) AS clipped, m.db <= 20 * log10(1.0) AS silent, round(CASE WHEN coalesce(k, 0) < 2 THEN m.db ELSE floor END, 6) AS floor_db
    FROM m LEFT JOIN c USING (label, block) LEFT JOIN f USING (label, block)""")
def rolling_meter(spark, sf_dir):
    """Levels, peaks, clipping, silence and noise floor over the ten newest blocks of a hundred samples."""
    m = rolling.meter(_chunks(spark, sf_dir), ["label"], "vec_id", "samples", 100, 10, silence=1.0)
    return m.select("label", "block", F.col("n").cast("long").alias("n"), "silent", F.round("clipped", 9).alias("clipped"), *(F.round(c, 6).alias(c) for c in ("rms_db", "peak_db", "floor_db")))


@registry.query(f"""WITH {_SAMPLES}, k AS (SELECT label, vec_id, count(*) FILTER (pos < 1000) AS kept, count(*) FILTER (pos >= 1000) AS overflow, count(*) FILTER (pos >= total - 1000) AS newest FROM (SELECT v.label, v.vec_id, row_number() OVER (PARTITION BY v.label ORDER BY v.vec_id, v.i) - 1 AS pos, count(*) OVER (PARTITION BY v.label) AS total FROM v) GROUP BY ALL) SELECT * FROM k""")
def buffered_samples(spark, sf_dir):
    """What buffers of a thousand samples take of each chunk, give back, and still hold at the end."""
    c = _chunks(spark, sf_dir)
    size = lambda c, name: F.size(c).cast("long").alias(name)
    first = rolling.filled(c, ["label"], "vec_id", "samples", 1000).select("label", "vec_id", size("kept", "kept"), size("overflow", "overflow"))
    return first.join(rolling.rolled(c, ["label"], "vec_id", "samples", 1000).select("vec_id", size("kept", "newest")), "vec_id")
