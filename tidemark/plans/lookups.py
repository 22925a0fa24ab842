"""Lookups, row mappings and session rules: orders are sessions, customers rooms, suppliers devices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import lookups, session_rules
from tidemark.plans.register import Registry, table

registry = Registry()

#: The same rows in SQL: kinds by status, overrides on some, cancelled ones by priority, open ends.
_S = """s AS (SELECT o_orderkey AS uid, o_custkey AS room_uid, CASE o_orderstatus WHEN 'F' THEN 'AUTO' WHEN 'O' THEN 'SCHEDULED' ELSE 'ON_DEMAND' END AS type,
    CASE WHEN o_orderpriority = '5-LOW' THEN o_orderdate END AS canceled_at, o_orderdate AS scheduled_start,
    CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate + INTERVAL 1 DAY END AS start_override,
    CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate + to_days(CAST(o_orderkey % 90 AS INTEGER)) END AS scheduled_end,
    CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate + INTERVAL 30 DAY END AS end_override, o_orderkey % 4 AS version FROM orders),
    e AS (SELECT *, coalesce(start_override, scheduled_start) AS effective_start, coalesce(end_override, scheduled_end) AS effective_end FROM s)"""
_NOW = "TIMESTAMP '1999-06-01'"


def now() -> F.Column:
    return F.lit("1999-06-01").cast("timestamp_ntz")


def days(n: F.Column | int) -> F.Column:
    return F.make_dt_interval(F.lit(n).cast("int") if isinstance(n, int) else n.cast("int"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key, day = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    out = o.select(
        key.alias("uid"), F.col("o_custkey").alias("room_uid"),
        F.when(F.col("o_orderstatus") == "F", "AUTO").when(F.col("o_orderstatus") == "O", "SCHEDULED").otherwise("ON_DEMAND").alias("type"),
        F.when(F.col("o_orderpriority") == "5-LOW", day).alias("canceled_at"), day.alias("scheduled_start"),
        F.when(key % 7 == 0, day + days(1)).alias("start_override"), F.when(key % 5 > 0, day + days(key % 90)).alias("scheduled_end"),
        F.when(key % 11 == 0, day + days(30)).alias("end_override"), (key % 4).alias("version"),
    )
    return out.withColumn("effective_start", session_rules.effective_start()).withColumn("effective_end", session_rules.effective_end())


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers sit in the room of their own number where that is even; every fourth one is its source."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").where(k % 2 == 0).select(k.alias("device_uid"), k.alias("room_uid"), (k % 4 == 0).alias("is_source"))


_M = "m AS (SELECT s_suppkey AS device_uid, s_suppkey AS room_uid, s_suppkey % 4 = 0 AS is_source FROM supplier WHERE s_suppkey % 2 = 0)"
_DAYS = "'{' || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'MON' ELSE 'MON,WED' END || '}'"


def _recurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key, start = F.col("p_size"), F.col("p_partkey"), F.lit("1999-01-01").cast("timestamp_ntz")
    text = F.when(size % 3 == 0, "{}").when(size % 3 == 1, "{MON}").otherwise("{MON,WED}")
    return table(spark, sf_dir, "part").select(
        key.alias("uid"), (key % 50).alias("room_uid"), F.col("p_name").alias("name"), start.alias("active_start"),
        F.when(size % 2 == 0, start + days(size)).alias("active_end"), start.alias("anchor_start"), F.lit("09:00").alias("local_start_time"),
        F.lit("10:00").alias("local_end_time"), F.lit("WEEKLY").alias("frequency"), text.alias("days_of_week"),
    )


@registry.query(f"SELECT p_partkey AS uid, list_filter(string_split(trim({_DAYS}, '{{}}'), ','), lambda x: x <> '') AS days FROM part")
def enum_arrays(spark, sf_dir):
    return _recurring(spark, sf_dir).select("uid", lookups.enum_array("days_of_week").alias("days"))


@registry.query("""SELECT p_partkey AS uid, p_partkey % 50 AS "roomUid", p_name AS name, CASE WHEN p_size % 2 = 0 THEN TIMESTAMP '1999-01-01' + to_days(p_size) END AS "activeEnd", 'WEEKLY' AS frequency,
    len(list_filter([p_size % 3 > 0, p_size % 3 > 1], lambda x: x)) AS n_days FROM part""")
def mapped_schedules(spark, sf_dir):
    s = lookups.schedules(_recurring(spark, sf_dir))
    return s.select("uid", "roomUid", "name", "activeEnd", "frequency", F.size("daysOfWeek").cast("long").alias("n_days"))


@registry.query("""SELECT p_partkey AS uid, p_partkey % 50 AS "roomUid", '09:00' AS "localStartTime", p_size % 3 AS n_days FROM part""")
def mapped_windows(spark, sf_dir):
    w = lookups.windows(_recurring(spark, sf_dir))
    return w.select("uid", "roomUid", "localStartTime", F.size("daysOfWeek").alias("n_days"))


@registry.query(f"""WITH {_M} SELECT s_suppkey AS uid, s_name AS name, s_acctbal > 0 AS active, room_uid AS "roomUid", coalesce(is_source, false) AS "isSource" FROM supplier LEFT JOIN m ON device_uid = s_suppkey""")
def mapped_devices(spark, sf_dir):
    never = F.lit(None).cast("timestamp_ntz")
    d = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("uid"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("active"), never.alias("last_seen_at"), never.alias("created_at")
    )
    joined = d.join(members(spark, sf_dir).withColumnRenamed("device_uid", "uid"), "uid", "left")
    return lookups.devices(joined).select("uid", "name", "active", "roomUid", "isSource")


@registry.query("""SELECT c_custkey AS uid, c_name AS name, n_name AS timezone, c_acctbal > 0 AS "autoSessionEnabled" FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def mapped_rooms(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 nations
    rows = c.select(
        F.col("c_custkey").alias("uid"), F.col("c_name").alias("name"), F.col("n_name").alias("timezone"), (F.col("c_acctbal") > 0).alias("auto_session_enabled"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
    )
    return lookups.rooms(rows).select("uid", "name", "timezone", "autoSessionEnabled")


@registry.query("SELECT p_partkey AS uid, p_name AS name FROM part WHERE p_partkey = 17")
def schedule_by_uid(spark, sf_dir):
    return lookups.point(_recurring(spark, sf_dir), "uid", 17, "uid", "name")


@registry.query("SELECT p_partkey AS uid, '10:00' AS local_end_time FROM part WHERE p_partkey = 18")
def window_by_uid(spark, sf_dir):
    return lookups.point(_recurring(spark, sf_dir), "uid", 18, "uid", "local_end_time")


@registry.query(f"WITH {_S} SELECT uid, room_uid, type, effective_start, effective_end FROM e WHERE uid = 77")
def session_by_uid(spark, sf_dir):
    return lookups.point(sessions(spark, sf_dir), "uid", 77, "uid", "room_uid", "type", "effective_start", "effective_end")


@registry.query("SELECT c_custkey AS uid, c_name AS name FROM customer WHERE c_custkey = 5")
def locked_room(spark, sf_dir):
    rooms = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("name"))
    return lookups.locked(rooms, "uid", 5, "name")


@registry.query("SELECT o_orderkey AS uid FROM orders WHERE o_orderkey = 40")
def locked_session(spark, sf_dir):
    return lookups.locked(sessions(spark, sf_dir), "uid", 40)


@registry.query(f"WITH {_S} SELECT uid, room_uid, effective_start, effective_end, canceled_at, version FROM e WHERE uid = 77")
def session_for_auth(spark, sf_dir):
    return lookups.session_for_auth(sessions(spark, sf_dir), 77)


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code for every shipment of an order, valid for the week before it ships."""
    ship, day = F.col("l_shipdate").cast("timestamp_ntz"), days(7)
    code = F.upper(F.lpad(F.hex(F.col("l_orderkey") * 8 + F.col("l_linenumber")), 8, "0"))
    return table(spark, sf_dir, "lineitem").select(code.alias("join_code"), F.col("l_orderkey").alias("session_uid"), (ship - day).alias("valid_start"), ship.alias("valid_end"))


_C = "c AS (SELECT lpad(upper(to_hex(l_orderkey * 8 + l_linenumber)), 8, '0') AS join_code, l_orderkey AS session_uid, l_shipdate - INTERVAL 7 DAY AS valid_start, l_shipdate AS valid_end FROM lineitem)"


@registry.query(f"WITH {_C} SELECT DISTINCT join_code, session_uid FROM c WHERE join_code = (SELECT max(join_code) FROM c)")
def join_code_by_code(spark, sf_dir):
    codes = _codes(spark, sf_dir)
    last = codes.agg(F.max("join_code").alias("join_code"))
    return codes.join(F.broadcast(last), "join_code").select("join_code", "session_uid").distinct()  # one row


@registry.query(f"WITH {_C} SELECT join_code, valid_start, valid_end FROM c WHERE session_uid = 33 AND valid_end > TIMESTAMP '1996-01-01'")
def active_join_codes(spark, sf_dir):
    return lookups.active_codes(_codes(spark, sf_dir), 33, F.lit("1996-01-01").cast("timestamp_ntz")).select("join_code", "valid_start", "valid_end")


@registry.query("SELECT s_suppkey AS uid, s_name AS name FROM supplier WHERE s_name = 'Supplier#000000003'")
def device_by_activation_code(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("uid"), F.col("s_name").alias("name"))
    return lookups.point(d, "name", "Supplier#000000003")


@registry.query("SELECT event_id AS uid, user_id AS session_uid FROM events WHERE event_id = 12")
def refresh_token_by_uid(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(F.col("event_id").alias("uid"), F.col("user_id").alias("session_uid"))
    return lookups.point(t, "uid", 12)


@registry.query(f"WITH {_M} SELECT room_uid, is_source FROM m WHERE device_uid = 8")
def room_membership(spark, sf_dir):
    return lookups.point(members(spark, sf_dir), "device_uid", 8, "room_uid", "is_source")


@registry.query(f"WITH {_M} SELECT min(device_uid) AS device_uid FROM m WHERE room_uid = 4 AND is_source")
def source_device(spark, sf_dir):
    return lookups.source_of_room(members(spark, sf_dir), 4)


@registry.query(f"WITH {_M} SELECT count(*) > 0 AS is_source FROM m WHERE device_uid = 8 AND room_uid = 8 AND is_source")
def device_is_source(spark, sf_dir):
    return lookups.is_source_for(members(spark, sf_dir), 8, 8)


@registry.query(f"""WITH {_S} SELECT uid, canceled_at IS NOT NULL OR coalesce(effective_end <= {_NOW}, false) AS ended,
    CASE WHEN {_NOW} < effective_start THEN 'before' WHEN effective_end IS NOT NULL AND {_NOW} > effective_end THEN 'after' ELSE 'within' END AS window_state,
    type = 'SCHEDULED' AND canceled_at IS NULL AND effective_start > {_NOW} AS can_cancel, type <> 'AUTO' AND effective_start > {_NOW} AS can_start_early,
    type <> 'AUTO' AND effective_start <= {_NOW} AND (effective_end IS NULL OR effective_end > {_NOW}) AS can_end_early FROM e""")
def session_rules_at(spark, sf_dir):
    r = session_rules
    return sessions(spark, sf_dir).select(
        "uid", r.is_ended(now()).alias("ended"), r.window_state(now()).alias("window_state"), r.can_cancel(now()).alias("can_cancel"),
        r.can_start_early(now()).alias("can_start_early"), r.can_end_early(now()).alias("can_end_early"),
    )


@registry.query("SELECT event_id, event_type = 'error' AND CAST(user_id % 3 AS VARCHAR) = '1' AS hit FROM events")
def label_subset(spark, sf_dir):
    labels = F.create_map(F.lit("type"), F.col("event_type"), F.lit("shard"), (F.col("user_id") % 3).cast("string"), F.lit("host"), F.lit("h"))
    e = table(spark, sf_dir, "events").select("event_id", labels.alias("labels"))
    return e.select("event_id", lookups.matches_subset("labels", {"type": "error", "shard": "1"}).alias("hit"))


@registry.query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN 'db: ok' WHEN s_suppkey % 4 = 2 THEN 'redis: down' ELSE 'db: ok; redis: down' END AS checks FROM supplier""")
def readiness_checks(spark, sf_dir):
    k = F.col("s_suppkey") % 4
    m = F.create_map(F.lit("db"), F.when(k.isin(1, 3), "ok"), F.lit("redis"), F.when(k.isin(2, 3), "down"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", lookups.summarized_checks(m).alias("checks"))


@registry.query(f"WITH {_M} SELECT s_suppkey AS uid FROM supplier WHERE s_suppkey NOT IN (SELECT device_uid FROM m)")
def devices_without_room(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("uid"))
    return lookups.unassigned(d, members(spark, sf_dir))


@registry.query("""SELECT p_partkey AS uid FROM part WHERE p_partkey % 50 = 7 AND (p_size % 2 > 0 OR TIMESTAMP '1999-01-01' + to_days(p_size) > TIMESTAMP '1999-01-20')""")
def open_schedules(spark, sf_dir):
    return lookups.open_schedules(_recurring(spark, sf_dir), 7, F.lit("1999-01-20").cast("timestamp_ntz")).select("uid")


@registry.query(f"""WITH {_S} SELECT uid, room_uid FROM e WHERE type IN ('SCHEDULED', 'ON_DEMAND') AND canceled_at IS NULL AND effective_start < TIMESTAMP '1999-07-01' AND (effective_end IS NULL OR effective_end > {_NOW})""")
def planned_sessions_in_range(spark, sf_dir):
    end = F.lit("1999-07-01").cast("timestamp_ntz")
    return lookups.sessions_in_range(sessions(spark, sf_dir), ["SCHEDULED", "ON_DEMAND"], now(), end).select("uid", "room_uid")


@registry.query(f"""WITH {_S} SELECT room_uid, min(effective_start) AS next_start FROM e WHERE type IN ('SCHEDULED', 'ON_DEMAND') AND canceled_at IS NULL AND effective_start > {_NOW} GROUP BY 1""")
def next_planned_start(spark, sf_dir):
    return lookups.next_start(sessions(spark, sf_dir), ["room_uid"], ["SCHEDULED", "ON_DEMAND"], now())


@registry.query(f"WITH {_S} SELECT uid, room_uid, effective_start FROM e WHERE type = 'AUTO' AND effective_start > {_NOW}")
def upcoming_auto_sessions(spark, sf_dir):
    return lookups.upcoming(sessions(spark, sf_dir), ["AUTO"], now()).select("uid", "room_uid", "effective_start")


#: Fleet rows: an order's upstream state, ends and latency; audio of the orders that shipped something.
_F = """a AS (SELECT l_orderkey, arg_max(struct_pack(q := l_quantity, d := l_discount, t := l_tax), (l_shipdate, l_linenumber, l_partkey, l_quantity, l_discount)) AS a FROM lineitem GROUP BY 1),
    f AS (SELECT o_orderkey::VARCHAR AS session_uid, o_custkey::VARCHAR AS room_uid, o_orderpriority AS provider,
      CASE WHEN o_orderkey % 13 = 0 THEN 'crit' ELSE CASE o_orderkey % 6 WHEN 0 THEN 'good' WHEN 1 THEN 'warn' WHEN 2 THEN 'warn' WHEN 3 THEN 'warn' WHEN 4 THEN 'crit' ELSE 'idle' END END AS status,
      CASE WHEN a IS NULL THEN CASE WHEN o_orderkey % 6 = 0 THEN 'crit' ELSE 'unknown' END WHEN a.q > 48 THEN 'unknown' WHEN a.q < 2 THEN 'crit' WHEN a.d / 5 > 0.01 THEN 'crit'
        WHEN -a.q - 5 < -50 OR -a.q - 5 > -6 OR (o_orderkey % 2 = 0 AND a.t * 200 < 10) THEN 'warn' ELSE 'good' END AS audio_status,
      CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS p95 FROM orders LEFT JOIN a ON l_orderkey = o_orderkey)"""


def fleet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("d"), F.col("l_tax").cast("double").alias("t"),
        "l_shipdate", "l_linenumber", "l_partkey",
    )
    audio = session_rules.latest_audio(line, "o_orderkey", ["l_shipdate", "l_linenumber", "l_partkey", "q", "d"])
    o, key = table(spark, sf_dir, "orders").join(audio, "o_orderkey", "left"), F.col("o_orderkey")
    names = F.array(*map(F.lit, ("OPEN", "WAITING_RETRY", "CONNECTING", "HANDSHAKING", "CLOSED", "IDLE")))
    upstream, a = names[(key % 6).cast("int")], F.col("audio")
    status = session_rules.session_status(upstream, F.when(key % 13 == 0, False), F.when(key % 13 == 0, True))
    level = -a["q"] - 5
    heard = session_rules.audio_status(a.isNotNull(), upstream, a["q"] <= 48, a["q"] < 2, a["d"] / 5, level, key % 2 == 0, a["t"] * 200)
    latency = F.array(F.struct(
        F.lit("pipeline").alias("measure"), F.lit("final").alias("kind"), (key % 3).alias("count"), F.col("o_totalprice").alias("p95")
    ))
    o = o.withColumn("latency", latency)
    return o.select(
        key.cast("string").alias("session_uid"), F.col("o_custkey").cast("string").alias("room_uid"), F.col("o_orderpriority").alias("provider"),
        status.alias("status"), heard.alias("audio_status"), session_rules.pipeline_p95().alias("p95"),
    )


@registry.query(f"WITH {_F} SELECT * FROM f")
def fleet_session_rows(spark, sf_dir):
    return fleet_rows(spark, sf_dir)


@registry.query(f"WITH {_F} SELECT * FROM f WHERE status IN ('crit', 'warn') AND provider = '1-URGENT' AND audio_status IN ('good', 'warn') AND (contains(session_uid, '12') OR contains(room_uid, '12'))")
def filtered_fleet_sessions(spark, sf_dir):
    return session_rules.filtered(fleet_rows(spark, sf_dir), ["crit", "warn"], "1-URGENT", ["good", "warn"], " 12 ")


@registry.query("SELECT l_orderkey, count(*) AS n, max(l_shipdate) AS last FROM lineitem GROUP BY 1")
def audio_by_session(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("timestamp_ntz").alias("at"), "l_linenumber", "l_partkey")
    last = session_rules.latest_audio(line, "l_orderkey", ["at", "l_linenumber", "l_partkey"])
    n = line.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return last.join(n, "l_orderkey").select("l_orderkey", "n", F.col("audio.at").alias("last"))
